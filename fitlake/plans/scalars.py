"""Functions of single values as queries on the driver's tables: paces, labels, profiles of sports, times, wire values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar, sports
from .queries import query, table

_MS = "(floor({x} + 0.5)::BIGINT // 60) || ':' || lpad((floor({x} + 0.5)::BIGINT % 60)::VARCHAR, 2, '0')"


def _ms(x: str) -> str:
    return _MS.format(x=x)


_STYLES = "(SELECT *, CASE k WHEN 'per_km' THEN 1000.0 WHEN 'per_100m' THEN 100.0 WHEN 'per_500m' THEN 500.0 END AS base FROM (SELECT p_partkey, p_retailprice / 400 AS speed, ['per_km', 'per_100m', 'per_500m', 'speed'][1 + p_partkey % 4] AS k FROM part))"


def _styles(spark, sf_dir):
    style = F.get(F.array(*map(F.lit, ("per_km", "per_100m", "per_500m", "speed"))), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 400).alias("speed"), style.alias("k"))


@query(f"""SELECT p_partkey, base / speed AS pace, CASE k WHEN 'per_500m' THEN (floor(base / speed * 10 + 0.5)::BIGINT // 600) || ':' || lpad((floor(base / speed * 10 + 0.5)::BIGINT % 600 // 10)::VARCHAR, 2, '0') || '.' || (floor(base / speed * 10 + 0.5)::BIGINT % 10) || '/500m'
  WHEN 'per_km' THEN {_ms('base / speed')} || '/km' WHEN 'per_100m' THEN {_ms('base / speed')} || '/100m' END AS text FROM {_STYLES}""")
def pace_styles(spark, sf_dir):
    """Paces as sports show them, with tenths for 500 m, and none where speed is shown."""
    pace = sports.pace(F.col("speed"), F.col("k"))
    return _styles(spark, sf_dir).select("p_partkey", pace.alias("pace"), sports.pace_text(pace, F.col("k"), suffix=True).alias("text"))


@query("SELECT p_partkey, 1000.0 / (100 + p_size) AS speed, round_even((100 + p_size) * 3.6, 1)::DECIMAL(20,1)::VARCHAR AS kmh FROM (SELECT p_partkey, p_size::DOUBLE AS p_size FROM part)")
def speed_from_pace(spark, sf_dir):
    pace = (F.lit(100) + F.col("p_size")).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", scalar.speed_from_pace(pace).alias("speed"), scalar.format_speed_kmh(pace).alias("kmh"))


@query("SELECT p_partkey, round(2.80 / pow((90.0 + p_size) / 500, 3), 6) AS watts, round(500 * pow(2.80 / (100.0 + p_size), 1 / 3.0), 6) AS pace FROM part")
def rowing_power(spark, sf_dir):
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(scalar.rowing_watts(90 + size), 6).alias("watts"), F.round(scalar.rowing_pace(100 + size), 6).alias("pace"))


_SPORT = "['running', 'cycling', 'swimming', 'rowing', 'walking', 'fitness_equipment', 'yoga', 'Cross_Country_Skiing'][1 + c_custkey % 8]"
_SUB = "['open_water', 'indoor_rowing', 'row_machine', NULL, 'generic'][1 + c_custkey % 5]"
_PROFILE = f"""(SELECT c_custkey, CASE WHEN sport = 'swimming' THEN CASE WHEN sub = 'open_water' THEN 'open_water_swim' ELSE 'pool_swim' END
  WHEN sub = 'indoor_rowing' OR (sport = 'fitness_equipment' AND contains(sub, 'row')) THEN 'rowing' WHEN sport = 'walking' THEN 'hiking'
  WHEN sport IN ('running', 'cycling', 'rowing', 'hiking', 'cross_country_skiing') THEN sport ELSE 'generic' END AS profile
FROM (SELECT c_custkey, lower({_SPORT}) AS sport, lower(coalesce({_SUB}, '')) AS sub FROM customer))"""


def _profiles(spark, sf_dir):
    pick = lambda names, n: F.get(F.array(*(F.lit(x) for x in names)), (F.col("c_custkey") % n).cast("int"))
    sport = pick(("running", "cycling", "swimming", "rowing", "walking", "fitness_equipment", "yoga", "Cross_Country_Skiing"), 8)
    sub = pick(("open_water", "indoor_rowing", "row_machine", None, "generic"), 5)
    return table(spark, sf_dir, "customer").select("c_custkey", sports.profile_of(sport, sub).alias("profile"))


@query(f"""SELECT c_custkey, profile, CASE WHEN profile IN ('running', 'hiking', 'cross_country_skiing', 'generic') THEN 'per_km' WHEN profile = 'cycling' THEN 'speed' WHEN profile = 'rowing' THEN 'per_500m' ELSE 'per_100m' END AS style,
  CASE WHEN profile IN ('cycling', 'rowing') AND c_custkey % 3 = 0 THEN 'power' WHEN c_custkey % 7 <> 0 THEN 'speed' ELSE 'none' END AS signal FROM {_PROFILE}""")
def sport_profiles(spark, sf_dir):
    """How a sport measures itself, and the signal that tells effort of what there is."""
    k, p = F.col("c_custkey"), F.col("profile")
    signal = sports.primary_signal(p, k % 3 == 0, k % 7 != 0)
    return _profiles(spark, sf_dir).select("c_custkey", "profile", sports.pace_style(p).alias("style"), signal.alias("signal"))


@query(f"""SELECT c_custkey, CASE WHEN profile = 'running' AND cadence < 130 THEN cadence * 2 ELSE cadence END AS value,
  CASE WHEN profile IN ('running', 'hiking', 'cross_country_skiing') THEN 'spm' WHEN profile IN ('cycling', 'generic') THEN 'rpm' ELSE 'strokes/min' END AS units,
  CASE WHEN profile = 'running' AND cadence < 130 THEN 'doubled_per_leg_cadence' END AS note FROM (SELECT *, (60 + c_custkey % 120)::DOUBLE AS cadence FROM {_PROFILE})""")
def cadence_display(spark, sf_dir):
    shown = sports.cadence_display((60 + F.col("c_custkey") % 120).cast("double"), F.col("profile"))
    return _profiles(spark, sf_dir).select("c_custkey", shown.alias("x")).select("c_custkey", "x.value", "x.units", "x.note")


@query(f"""SELECT p_partkey, n || ' x ' || CASE WHEN swim AND dist IS NOT NULL THEN dist::BIGINT || 'm' WHEN dist >= 200 AND k <> 'speed' THEN CASE WHEN dist >= 950 THEN round_even(dist / 1000, 1)::DECIMAL(18,1)::VARCHAR || 'km' ELSE dist::BIGINT || 'm' END
    ELSE {_ms('dur')} END || coalesce(CASE k WHEN 'speed' THEN ' @ ' || round_even(speed * 100, 0)::BIGINT || ' W' WHEN 'per_km' THEN ' @ ' || {_ms('1000 / (speed * 100)')} || '/km' WHEN 'per_100m' THEN ' @ ' || {_ms('100 / (speed * 100)')} || '/100m'
      ELSE ' @ ' || (floor(500 / (speed * 100) * 10 + 0.5)::BIGINT // 600) || ':' || lpad((floor(500 / (speed * 100) * 10 + 0.5)::BIGINT % 600 // 10)::VARCHAR, 2, '0') || '.' || (floor(500 / (speed * 100) * 10 + 0.5)::BIGINT % 10) || '/500m' END, '')
  || coalesce(' rest ' || {_ms('rest')}, '') AS label
FROM (SELECT *, 2 + p_partkey % 7 AS n, CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey % 60) * 25.0 END AS dist, (p_partkey % 500)::DOUBLE AS dur, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 90)::DOUBLE END AS rest, k = 'per_100m' AS swim FROM {_STYLES})""")
def interval_labels(spark, sf_dir):
    """Repeats in words."""
    k = F.col("p_partkey")
    label = sports.interval_label(
        2 + k % 7, (k % 500).cast("double"), F.when(k % 11 != 0, k % 60 * F.lit(25.0)), F.col("speed") * 100, F.when(k % 5 != 0, (k % 90).cast("double")), F.col("k"), F.col("k") == "per_100m"
    )
    return _styles(spark, sf_dir).select("p_partkey", label.alias("label"))


@query("""SELECT event_id, strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS utc, strftime(make_timestamp((s - 90061) * 1000000), '%Y-%m-%dT%H:%M:%S') AS local
FROM (SELECT event_id, epoch_us(ts) // 1000000 - 1000003 * (event_id % 2000) AS s FROM events)""")
def iso_times(spark, sf_dir):
    """Times as text, of whole seconds since 1970, before and after it."""
    s = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) - 1_000_003 * (F.col("event_id") % 2000)
    return table(spark, sf_dir, "events").select("event_id", scalar.iso_utc(s).alias("utc"), scalar.iso_local(s - 90_061).alias("local"))


@query("""SELECT s_suppkey, 111320.0 * (abs(lat2 - lat1) + abs(lon2 - lon1)) > 42 * (s_suppkey % 1000) AS may_be_fast
FROM (SELECT s_suppkey, (s_suppkey % 120)::DOUBLE / 100 AS lat1, (s_suppkey * 7 % 300)::DOUBLE / 100 AS lon1, s_nationkey / 50.0 AS lat2, s_nationkey / 20.0 AS lon2 FROM supplier)""")
def degree_prefilter(spark, sf_dir):
    """A bound on speed by degrees, that spares most points the trigonometry."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    fast = scalar.may_be_fast((k % 120).cast("double") / 100, (k * 7 % 300).cast("double") / 100, n / 50.0, n / 20.0, k % 1000, 42)
    return table(spark, sf_dir, "supplier").select("s_suppkey", fast.alias("may_be_fast"))


@query("SELECT o_orderkey, (o_totalprice > 50000)::INT + (o_totalprice > 100000.5)::INT + (o_totalprice > 200000)::INT AS zone FROM orders")
def bounds_of_text(spark, sf_dir):
    """Zones by bounds that are given as text."""
    zone = F.size(F.filter(F.array(*map(F.lit, scalar.zone_bounds("50000,100000.5,200000"))), lambda b: F.col("o_totalprice") > b))
    return table(spark, sf_dir, "orders").select("o_orderkey", zone.alias("zone"))
