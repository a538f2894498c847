"""The engine's operators as queries on the driver's tables, each with the same query in DuckDB's SQL.

A user of ``events`` stands for a recorded workout, ``value`` for a sensor's stream. Thresholds are
scaled to how often events come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import matching, series

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

KEY, ORDER = ["user_id"], ["t", "event_id"]
#: The records of all oracles: microseconds as t.
_E = "(SELECT *, epoch_us(ts) AS t FROM events)"
_W = "PARTITION BY user_id ORDER BY t, event_id"


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t", series.micros(F.col("ts")))


@query(f"SELECT user_id, event_id, lead(t) OVER ({_W}) - t AS dt FROM {_E}")
def pair_dt(spark, sf_dir):
    return series.pairwise_dt(records(spark, sf_dir), KEY, ORDER).select("user_id", "event_id", "dt")


@query(f"""SELECT user_id, sum(least(dt, 600000000))::BIGINT AS moving_us
FROM (SELECT *, lead(t) OVER ({_W}) - t AS dt FROM {_E}) WHERE dt > 0 AND value > 20 GROUP BY user_id""")
def moving_time(spark, sf_dir):
    return series.moving_time(records(spark, sf_dir), KEY, ORDER, F.col("value") > 20, cap_s=600)


@query(f"""SELECT user_id, t, end_t, end_t - t AS gap_us,
  CASE WHEN stop OR end_stop THEN 'manual_stop' WHEN end_t - t <= 14400000000 THEN 'smart_recording' ELSE 'unknown' END AS kind
FROM (SELECT user_id, t, event_type = 'error' AS stop, lead(t) OVER ({_W}) AS end_t, lead(event_type = 'error') OVER ({_W}) AS end_stop FROM {_E})
WHERE end_t - t >= 3600000000""")
def gap_classify(spark, sf_dir):
    return series.classify_gaps(records(spark, sf_dir), KEY, ORDER, F.col("event_type") == "error", 3600, 14400)


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 17 <> 0 THEN epoch_us(ts) END AS t FROM events),
c AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried_t FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY carried_t NULLS FIRST, event_id) AS position,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM c)
SELECT user_id, event_id, carried_t, position::INT AS position, position <> was AS moved FROM p""")
def stable_order(spark, sf_dir):
    df = records(spark, sf_dir).withColumn("t", F.when(F.col("event_id") % 17 != 0, F.col("t")))
    return series.stable_order(df, KEY, "event_id").select("user_id", "event_id", "carried_t", "position", "moved")


_RUNS = """(SELECT user_id, run, v, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM (
    SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY user_id ORDER BY t, event_id) THEN 0 ELSE 1 END AS new
    FROM (SELECT user_id, event_id, epoch_us(ts) AS t, event_type AS v FROM events)))
  GROUP BY user_id, run, v)"""


@query(f"SELECT user_id, max(n) AS longest FROM {_RUNS} GROUP BY user_id")
def flatline(spark, sf_dir):
    return series.longest_run(records(spark, sf_dir), KEY, ORDER, F.col("event_type"))


@query(f"SELECT v AS event_type, n AS length, count(*) AS n_runs FROM {_RUNS} GROUP BY v, n")
def run_lengths(spark, sf_dir):
    found = series.runs(records(spark, sf_dir), KEY, ORDER, F.col("event_type"))
    return found.groupBy(F.col("v").alias("event_type"), F.col("n").alias("length")).agg(F.count(F.lit(1)).alias("n_runs"))


@query(f"""SELECT user_id, count(*) FILTER (value < b) AS decreases, count(*) FILTER (value < 30 AND b > 100) AS resets
FROM (SELECT *, lag(value) OVER ({_W}) AS b FROM {_E}) GROUP BY user_id""")
def distance_resets(spark, sf_dir):
    return series.resets(records(spark, sf_dir), KEY, ORDER, "value", 30, 100)


@query(f"""SELECT event_id, user_id, round(median(value) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS smooth FROM {_E}""")
def rolling_median(spark, sf_dir):
    out = series.rolling_median(records(spark, sf_dir), KEY, ORDER, "value")
    return out.select("event_id", "user_id", F.round("smooth", 6).alias("smooth"))


_REF = """(SELECT user_id, (h[1 + floor(0.2 * (len(h) - 1))::INT] + h[1 + floor(0.8 * (len(h) - 1))::INT]) / 2 AS reference
FROM (SELECT user_id, list_sort(list(value)) AS h FROM events WHERE value > 0 GROUP BY user_id))"""


@query(f"SELECT user_id, round(reference, 6) AS reference FROM {_REF}")
def band_reference(spark, sf_dir):
    out = series.band_reference(records(spark, sf_dir), KEY, "value")
    return out.select("user_id", F.round("reference", 6).alias("reference"))


@query(f"""SELECT event_id, coalesce(last_value(c IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'recovery') AS state
FROM (SELECT e.*, CASE WHEN value >= 1.10 * reference THEN 'work' WHEN value <= 0.85 * reference THEN 'recovery' END AS c
      FROM {_E} e JOIN {_REF} r USING (user_id))""")
def hysteresis_bands(spark, sf_dir):
    df = records(spark, sf_dir)
    both = df.join(series.band_reference(df, KEY, "value"), KEY)
    return series.hysteresis_bands(both, KEY, ORDER, "value", "reference").select("event_id", "state")


@query(f"""WITH s AS (SELECT user_id, (value > 20)::INT + (value > 50)::INT + (value > 100)::INT AS zone, lead(t) OVER ({_W}) - t AS dt FROM {_E}),
z AS (SELECT user_id, zone, sum(least(dt, 600000000))::BIGINT AS us FROM s WHERE dt > 0 GROUP BY ALL)
SELECT u.user_id, g.zone::INT AS zone, coalesce(z.us, 0)::BIGINT AS us
FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(4)) AS zone) g
LEFT JOIN z ON z.user_id = u.user_id AND z.zone = g.zone""")
def zones(spark, sf_dir):
    return series.zone_time(records(spark, sf_dir), KEY, ORDER, "value", [20, 50, 100], 600)


@query(f"""SELECT user_id, round(max(m5), 6) AS best_5, round(max(m20), 6) AS best_20 FROM (
  SELECT user_id,
    CASE WHEN row_number() OVER ({_W}) >= 5 AND count(p) OVER ({_W} ROWS 4 PRECEDING) >= 5 THEN avg(p) OVER ({_W} ROWS 4 PRECEDING) END AS m5,
    CASE WHEN row_number() OVER ({_W}) >= 20 AND count(p) OVER ({_W} ROWS 19 PRECEDING) >= 18 THEN avg(p) OVER ({_W} ROWS 19 PRECEDING) END AS m20
  FROM (SELECT *, CASE WHEN event_id % 11 <> 0 THEN value END AS p FROM {_E})) GROUP BY user_id""")
def mean_max(spark, sf_dir):
    df = records(spark, sf_dir).withColumn("p", F.when(F.col("event_id") % 11 != 0, F.col("value")))
    out = series.mean_max(df, KEY, ORDER, "p", [5, 20])
    return out.select("user_id", F.round("best_5", 6).alias("best_5"), F.round("best_20", 6).alias("best_20"))


@query(f"""SELECT user_id, round(pow(avg(CASE WHEN rn >= 30 THEN pow(m, 4) END), 0.25), 6) AS weighted FROM (
  SELECT user_id, row_number() OVER ({_W}) AS rn, avg(value) OVER ({_W} ROWS 29 PRECEDING) AS m FROM {_E}) GROUP BY user_id""")
def weighted_power(spark, sf_dir):
    out = series.weighted_mean(records(spark, sf_dir), KEY, ORDER, "value")
    return out.select("user_id", F.round("weighted", 6).alias("weighted"))


_HALF = f"(SELECT *, row_number() OVER ({_W}) <= count(*) OVER (PARTITION BY user_id) // 2 AS f FROM {_E})"


@query(f"""SELECT user_id, round(avg(value) FILTER (f), 6) AS first_half, round(avg(value) FILTER (NOT f), 6) AS second_half
FROM {_HALF} GROUP BY user_id HAVING count(*) FILTER (f) >= 30""")
def halves(spark, sf_dir):
    out = series.halves(records(spark, sf_dir), KEY, ORDER, "value", 30)
    return out.select("user_id", F.round("first_half", 6).alias("first_half"), F.round("second_half", 6).alias("second_half"))


@query(f"""SELECT user_id, round((1 - (sum(value) FILTER (NOT f) / sum(h) FILTER (NOT f)) / (sum(value) FILTER (f) / sum(h) FILTER (f))) * 100, 6) AS drift_pct
FROM (SELECT *, 100.0 + event_id % 80 AS h FROM {_HALF}) GROUP BY user_id HAVING count(*) FILTER (f) >= 30""")
def hr_drift(spark, sf_dir):
    df = records(spark, sf_dir).withColumn("h", 100.0 + F.col("event_id") % 80)
    return series.drift(df, KEY, ORDER, "value", "h", 30).select("user_id", F.round("drift_pct", 6).alias("drift_pct"))


@query("""SELECT user_id, round(count(*) FILTER (value < 30) * 100.0 / count(value), 6) AS coasting_pct FROM events
GROUP BY user_id HAVING count(value) >= 60 AND count(*) FILTER (value < 30) * 100.0 / count(value) >= 5""")
def coasting(spark, sf_dir):
    share = F.count_if(F.col("value") < 30) * F.lit(100.0) / F.count("value")
    out = records(spark, sf_dir).groupBy("user_id").agg(share.alias("share"), F.count("value").alias("n"))
    return out.where("n >= 60 AND share >= 5").select("user_id", F.round("share", 6).alias("coasting_pct"))


@query(f"""SELECT user_id, count(*) AS n_sets, max(n) AS largest FROM (
  SELECT user_id, s, count(*) AS n FROM (
    SELECT *, sum(new) OVER ({_W}) AS s FROM (
      SELECT *, CASE WHEN t - lag(t) OVER ({_W}) < 86400000000 THEN 0 ELSE 1 END AS new FROM {_E})) GROUP BY user_id, s)
GROUP BY user_id""")
def swim_sets(spark, sf_dir):
    out = series.sessions_by_rest(records(spark, sf_dir), KEY, ORDER, 86400 * series.MICROS)
    return out.groupBy("user_id", "set_no").count().groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sets"), F.max("count").alias("largest"))


@query(f"""WITH c AS (SELECT *, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'stop' END AS kind FROM {_E}),
d AS (SELECT * FROM (SELECT *, lag(kind) OVER ({_W}) AS b FROM c WHERE kind IS NOT NULL) WHERE b IS NULL OR b <> kind),
n AS (SELECT *, lead(t) OVER ({_W}) AS nt FROM d),
x AS (SELECT user_id, min(t) AS f, max(t) AS l FROM {_E} GROUP BY user_id)
SELECT user_id, sum(b - a)::BIGINT AS timer_us, count(*) AS n_intervals FROM (
  SELECT n.user_id, n.t AS a, coalesce(nt, l) AS b FROM n JOIN x USING (user_id) WHERE kind = 'start'
  UNION ALL SELECT n.user_id, f, n.t FROM n JOIN x USING (user_id) WHERE kind = 'stop' AND n.b IS NULL
  UNION ALL SELECT user_id, f, l FROM x WHERE user_id NOT IN (SELECT user_id FROM n)) GROUP BY user_id""")
def timer_intervals(spark, sf_dir):
    found = series.timer_intervals(
        records(spark, sf_dir), KEY, ORDER, F.col("event_type") == "signup", F.col("event_type") == "error"
    )
    return found.groupBy("user_id").agg(F.sum(F.col("b") - F.col("a")).alias("timer_us"), F.count(F.lit(1)).alias("n_intervals"))


_SESS = f"(SELECT user_id, row_number() OVER ({_W}) - 1 AS session, t AS a, t + 86400000000 AS b FROM {_E} WHERE event_type = 'signup')"


#: Records with the first session that holds them.
_OWNED = f"""(SELECT * FROM (SELECT e.*, session, row_number() OVER (PARTITION BY event_id ORDER BY session) AS rn
  FROM {_E} e JOIN {_SESS} s ON s.user_id = e.user_id AND e.t BETWEEN s.a AND s.b) WHERE rn = 1)"""


def _sessions(spark, sf_dir):
    from pyspark.sql import Window

    starts = records(spark, sf_dir).where("event_type = 'signup'")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1
    return starts.select("user_id", number.alias("session"), F.col("t").alias("a"), (F.col("t") + 86400 * series.MICROS).alias("b"))


@query(f"""SELECT user_id, event_id, session::INT AS session, outside = 0 AS inside FROM (
  SELECT e.user_id, event_id, session, (NOT e.t BETWEEN a AND b)::INT AS outside,
    row_number() OVER (PARTITION BY event_id ORDER BY (NOT e.t BETWEEN a AND b)::INT, CASE WHEN e.t BETWEEN a AND b THEN 0 ELSE abs(e.t - a) END, session) AS rn
  FROM {_E} e JOIN {_SESS} s USING (user_id)) WHERE rn = 1""")
def session_assign(spark, sf_dir):
    return matching.assign_sessions(records(spark, sf_dir), _sessions(spark, sf_dir), KEY, "event_id")


@query(f"""SELECT user_id, count(*) AS n_inside FROM {_E} e
WHERE EXISTS (SELECT 1 FROM {_SESS} s WHERE s.user_id = e.user_id AND e.t BETWEEN s.a AND s.b) GROUP BY user_id""")
def running_semi(spark, sf_dir):
    found = matching.inside_any(records(spark, sf_dir), _sessions(spark, sf_dir), KEY)
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_inside"))


@query(f"""SELECT s.user_id, s.session::INT AS session, count(*) AS n, round(avg(value), 6) AS mean, arg_min(value, (e.t, event_id)) AS first_value
FROM {_E} e JOIN {_SESS} s ON e.user_id = s.user_id AND e.t >= s.a AND e.t < s.b GROUP BY ALL""")
def interval_totals(spark, sf_dir):
    s = _sessions(spark, sf_dir)
    both = records(spark, sf_dir).join(s, KEY).where("t >= a AND t < b")
    return both.groupBy("user_id", "session").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min_by("value", F.struct("t", "event_id")).alias("first_value")
    )


@query(f"""SELECT user_id, event_id, session::INT AS session, distance::BIGINT AS distance FROM (
  SELECT e.user_id, event_id, session, abs(e.t - a) AS distance, row_number() OVER (PARTITION BY event_id ORDER BY abs(e.t - a), session) AS rn
  FROM {_E} e JOIN {_SESS} s USING (user_id) WHERE NOT EXISTS (SELECT 1 FROM {_SESS} x WHERE x.user_id = e.user_id AND e.t BETWEEN x.a AND x.b)) WHERE rn = 1""")
def session_assign_nearest(spark, sf_dir):
    s = _sessions(spark, sf_dir)
    owned = matching.assign_sessions(records(spark, sf_dir), s, KEY, "event_id").where("NOT inside")
    rows = owned.join(records(spark, sf_dir).select(*KEY, "event_id", "t"), [*KEY, "event_id"]).join(s, [*KEY, "session"])
    return rows.select("user_id", "event_id", "session", F.abs(F.col("t") - F.col("a")).alias("distance"))


@query(f"""SELECT e.user_id, count(*) AS n_outside FROM {_E} e JOIN (SELECT user_id FROM {_SESS} GROUP BY user_id HAVING count(*) > 1) m USING (user_id)
WHERE NOT EXISTS (SELECT 1 FROM {_SESS} s WHERE s.user_id = e.user_id AND e.t BETWEEN s.a AND s.b) GROUP BY e.user_id""")
def records_outside(spark, sf_dir):
    s = _sessions(spark, sf_dir)
    several = s.groupBy(*KEY).count().where("count > 1").select(*KEY)
    owned = matching.assign_sessions(records(spark, sf_dir), s, KEY, "event_id").where("NOT inside")
    return owned.join(several, KEY, "left_semi").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_outside"))


_DERIVED = """(SELECT l_orderkey AS k, sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)) * (1 + l_tax::DECIMAL(4,2)))::DOUBLE AS total, sum(l_quantity) AS qty, count(*) AS n
FROM lineitem GROUP BY l_orderkey)"""


def _derived(spark, sf_dir):
    exact = lambda c, n: F.col(c).cast(f"decimal({n},2)")
    price = exact("l_extendedprice", 12) * (1 - exact("l_discount", 4)) * (1 + exact("l_tax", 4))
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.sum(price).cast("double").alias("total"), F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n")
    )


@query(f"""SELECT o_orderkey AS k, 'total' AS field, o_totalprice AS declared, round(total, 6) AS derived
FROM orders JOIN {_DERIVED} d ON k = o_orderkey WHERE abs(total - o_totalprice) > greatest(10, 0.02 * abs(o_totalprice))""")
def declared_vs_derived(spark, sf_dir):
    declared = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"))
    found = matching.reconcile(declared, _derived(spark, sf_dir).select("k", "total"), ["k"], {"total": (10, 0.02)})
    return found.select("k", "field", "declared", F.round("derived", 6).alias("derived"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def records_missing(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey")


@query(f"""SELECT o_orderkey, round(coalesce(total, o_totalprice), 6) AS total, total IS NOT NULL AS enhanced,
  total IS NOT NULL AND abs(total - o_totalprice) > 0.01 AS disagrees FROM orders LEFT JOIN {_DERIVED} d ON k = o_orderkey""")
def enhanced_merge(spark, sf_dir):
    d = _derived(spark, sf_dir).withColumnRenamed("k", "o_orderkey")
    both = table(spark, sf_dir, "orders").join(d, "o_orderkey", "left")
    disagrees = F.coalesce(F.abs(F.col("total") - F.col("o_totalprice")) > 0.01, F.lit(False))
    return both.select(
        "o_orderkey", F.round(F.coalesce("total", "o_totalprice"), 6).alias("total"), F.col("total").isNotNull().alias("enhanced"), disagrees.alias("disagrees")
    )


@query("""SELECT user_id, event_type AS stream, count(value) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total, max(value) AS most
FROM events GROUP BY ALL""")
def stream_stats(spark, sf_dir):
    return records(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("stream")).agg(
        F.count("value").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"), F.max("value").alias("most")
    )


@query("""SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'error') AS error,
  max(value) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id""")
def stream_pivot(spark, sf_dir):
    return records(spark, sf_dir).groupBy("user_id").pivot("event_type", ["click", "error", "view"]).agg(F.max("value"))


@query("""SELECT event_type, user_id % 10 AS device, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total
FROM events GROUP BY CUBE (event_type, user_id % 10)""")
def fleet_cube(spark, sf_dir):
    df = records(spark, sf_dir).withColumn("device", F.col("user_id") % 10)
    return df.cube("event_type", "device").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


@query(f"""WITH d AS (SELECT user_id, event_id, t, sum(value) OVER ({_W}) AS dist FROM {_E}),
s AS (SELECT *, lag(dist) OVER ({_W}) AS d0, lag(t) OVER ({_W}) AS t0, first_value(dist) OVER ({_W}) AS o FROM d),
k AS (SELECT *, unnest(range((floor((d0 - o) / 500) + 1)::BIGINT, (floor((dist - o) / 500) + 1)::BIGINT)) AS split FROM s WHERE dist > d0)
SELECT user_id, split, t0 + round((o + split * 500 - d0) / (dist - d0) * (t - t0))::BIGINT AS t FROM k""")
def splits(spark, sf_dir):
    w = series.over(KEY, ORDER)
    df = records(spark, sf_dir).withColumn("dist", F.sum("value").over(w))
    return series.splits(df, KEY, ORDER, "dist", 500).select("user_id", "split", "t")


@query(f"""SELECT event_id, coalesce(abs(value - a) * 1000000 / nullif(greatest(t - ta, 0), 0) > 0.01 AND abs(b - value) * 1000000 / nullif(greatest(tb - t, 0), 0) > 0.01
  AND abs(b - a) * 1000000 / nullif(greatest(tb - ta, 0), 0) <= 0.01, false) AS spike
FROM (SELECT *, lag(value) OVER ({_W}) AS a, lead(value) OVER ({_W}) AS b, lag(t) OVER ({_W}) AS ta, lead(t) OVER ({_W}) AS tb FROM {_E})""")
def spike_gate(spark, sf_dir):
    return series.spikes(records(spark, sf_dir), KEY, ORDER, "value", 0.01).select("event_id", "spike")


@query("""SELECT event_id, CASE WHEN NOT bad THEN lat END AS lat, CASE WHEN NOT bad THEN lon END AS lon, bad AS null_island
FROM (SELECT event_id, event_id % 50 AS lat, event_id % 100 AS lon, event_id % 100 = 0 AS bad FROM events)""")
def null_island(spark, sf_dir):
    rows = records(spark, sf_dir).withColumns({"lat": F.col("event_id") % 50, "lon": F.col("event_id") % 100})
    bad = (F.col("lat") == 0) & (F.col("lon") == 0)
    return rows.select("event_id", F.when(~bad, F.col("lat")).alias("lat"), F.when(~bad, F.col("lon")).alias("lon"), bad.alias("null_island"))


@query(f"""SELECT user_id, max(n) AS longest FROM (
  SELECT user_id, grp, count(*) AS n FROM (
    SELECT user_id, still, sum(CASE WHEN still THEN 0 ELSE 1 END) OVER ({_W}) AS grp FROM (
      SELECT *, coalesce(floor(value / 100) = lag(floor(value / 100)) OVER ({_W}) AND value > 20, false) AS still FROM {_E}))
  WHERE still GROUP BY user_id, grp) GROUP BY user_id""")
def frozen_distance(spark, sf_dir):
    distance = F.floor(F.col("value") / 100)
    rows = records(spark, sf_dir).withColumn("still", F.coalesce((distance == F.lag(distance).over(series.over(KEY, ORDER))) & (F.col("value") > 20), F.lit(False)))
    return series.longest_run(rows, KEY, ORDER, F.when(F.col("still"), F.lit(1)))


@query(f"""SELECT user_id, session::INT AS session, zone::INT AS zone, coalesce(s, 0)::BIGINT AS spent_us FROM (
  SELECT DISTINCT user_id, session FROM {_OWNED}) k CROSS JOIN (SELECT unnest([0, 1, 2]) AS zone)
LEFT JOIN (SELECT user_id, session, (value > 100)::INT + (value > 300)::INT AS zone, sum(least(dt, 600000000)) AS s
  FROM (SELECT *, lead(t) OVER (PARTITION BY user_id, session ORDER BY t, event_id) - t AS dt FROM {_OWNED}) WHERE dt > 0 GROUP BY 1, 2, 3) USING (user_id, session, zone)""")
def session_zones(spark, sf_dir):
    s = _sessions(spark, sf_dir)
    owned = matching.assign_sessions(records(spark, sf_dir), s, KEY, "event_id").where("inside").select("event_id", "session")
    rows = records(spark, sf_dir).join(owned, "event_id")
    keys = [*KEY, "session"]
    steps = series.pairwise_dt(rows, keys, ORDER).where("dt > 0")
    zone = (F.col("value") > 100).cast("int") + (F.col("value") > 300).cast("int")
    spent = steps.groupBy(*keys, zone.alias("zone")).agg(F.sum(F.least("dt", F.lit(600 * series.MICROS))).alias("spent_us"))
    spine = rows.select(*keys).distinct().withColumn("zone", F.explode(F.array(*map(F.lit, range(3)))))
    return spine.join(spent, [*keys, "zone"], "left").select(*keys, "zone", F.coalesce("spent_us", F.lit(0)).alias("spent_us"))


@query(f"""SELECT event_id, (sum(back) OVER ({_W}))::BIGINT * 256 + c AS total FROM (
  SELECT *, CASE WHEN c < lag(c) OVER ({_W}) THEN 1 ELSE 0 END AS back FROM (SELECT *, event_id % 256 AS c FROM {_E}))""")
def accumulator_unwrap(spark, sf_dir):
    df = records(spark, sf_dir).withColumn("c", F.col("event_id") % 256)
    return series.unwrap(df, KEY, ORDER, "c", 256).select("event_id", "total")


@query("""SELECT l_orderkey, l_linenumber, l_partkey & 4095 AS low, (l_partkey >> 4) & 15 AS high,
  CASE WHEN (l_partkey & 127) <= 100 THEN CASE WHEN (l_partkey & 255) >= 128 THEN l_partkey & 127 ELSE 100 - (l_partkey & 127) END END AS balance FROM lineitem""")
def bit_unpack(spark, sf_dir):
    raw = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", raw.bitwiseAND(F.lit(4095)).alias("low"),
        F.shiftright(raw, 4).bitwiseAND(F.lit(15)).alias("high"),
        scalar.left_right_balance(raw.bitwiseAND(F.lit(255))).alias("balance"),
    )


@query("SELECT p_partkey, CASE WHEN p_size <> 50 THEN p_size / 5.0 - 2.0 END AS value FROM part")
def sentinel_scale(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalar.sentinel_to_null(F.col("p_size"), 50, 5, 2).alias("value"))


@query("""SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS nation FROM customer
LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey""")
def enum_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "nation").where("n_nationkey < 20").withColumnRenamed("n_nationkey", "c_nationkey")
    both = table(spark, sf_dir, "customer").join(names, "c_nationkey", "left")
    return both.select("c_custkey", F.coalesce("n_name", F.col("c_nationkey").cast("string")).alias("nation"))


@query("""SELECT source, arg_min(lang, doc_id) AS first_lang, min(doc_id) AS first_id FROM documents GROUP BY source""")
def first_wins(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min_by("lang", "doc_id").alias("first_lang"), F.min("doc_id").alias("first_id"))


@query("""SELECT kind, count(*) AS n FROM (
  SELECT CASE WHEN starts_with(h, '<') AND h LIKE '%<gpx%' THEN 'gpx' WHEN starts_with(h, '<') AND h LIKE '%<trainingcenterdatabase%' THEN 'tcx'
    WHEN starts_with(h, '<') AND (h LIKE '%<!doctype html%' OR h LIKE '%<html%') THEN 'html' WHEN starts_with(h, '<') THEN 'xml' WHEN starts_with(h, '{') OR starts_with(h, '[') THEN 'json'
    WHEN regexp_full_match(substring(h, 1, 256), '[\\x09-\\x7E]+') THEN 'text' ELSE 'none' END AS kind
  FROM (SELECT lower(ltrim(substring(x, 1, 512), ' ' || chr(9) || chr(10) || chr(13) || chr(65279))) AS h FROM (SELECT html AS x FROM pages UNION ALL SELECT props FROM events UNION ALL SELECT text FROM benchmark)))
GROUP BY kind""")
def sniff(spark, sf_dir):
    texts = (
        table(spark, sf_dir, "pages").select(F.col("html").alias("x"))
        .unionAll(table(spark, sf_dir, "events").select("props")).unionAll(table(spark, sf_dir, "benchmark").select("text"))
    )
    return texts.select(scalar.sniff(F.col("x")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(f"""SELECT source, count(*) FILTER (n > 0) AS rows_with, sum(n)::BIGINT AS found FROM (
  SELECT source, len(regexp_extract_all(text, '{_MAIL}')) AS n FROM documents) GROUP BY source""")
def pii_reveal(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select("source", F.regexp_count("text", F.lit(_MAIL)).alias("n"))
    return hits.groupBy("source").agg(F.count_if(F.col("n") > 0).alias("rows_with"), F.sum("n").alias("found"))


@query(f"SELECT doc_id, md5(regexp_replace(text, '{_MAIL}', '', 'g')) AS scrubbed FROM documents WHERE regexp_matches(text, '{_MAIL}')")
def pii_scrub(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(_MAIL))
    return docs.select("doc_id", F.md5(F.regexp_replace("text", _MAIL, "")).alias("scrubbed"))


@query("SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def dedupe_diag(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    return docs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT event_id, epoch_us(ts) + 3600000000 AS t FROM events WHERE epoch_us(ts) BETWEEN 1704153600000000 AND 1706745600000000")
def trim_and_shift(spark, sf_dir):
    df = records(spark, sf_dir).where(F.col("t").between(1704153600000000, 1706745600000000))
    return df.select("event_id", (F.col("t") + 3600 * series.MICROS).alias("t"))


@query("SELECT event_id, round(value * 1.25, 4) AS value FROM events")
def rescale(spark, sf_dir):
    return records(spark, sf_dir).select("event_id", F.round(F.col("value") * 1.25, 4).alias("value"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'power+ftp' WHEN o_orderstatus = 'F' THEN 'hr-trimp' END AS basis,
  CASE WHEN o_totalprice > 150000 THEN round(o_totalprice / 1000, 3) WHEN o_orderstatus = 'F' THEN round(o_totalprice / 2000, 3) END AS score FROM orders""")
def load_ladder(spark, sf_dir):
    total = F.col("o_totalprice")
    first = F.when(total > 150000, F.struct(F.lit("power+ftp").alias("basis"), F.round(total / 1000, 3).alias("score")))
    then = F.when(F.col("o_orderstatus") == "F", F.struct(F.lit("hr-trimp").alias("basis"), F.round(total / 2000, 3).alias("score")))
    return table(spark, sf_dir, "orders").withColumn("l", F.coalesce(first, then)).select("o_orderkey", "l.basis", "l.score")


@query("""SELECT c_custkey, CASE WHEN metres > 0 THEN round(coalesce(nullif(moving, 0), nullif(timer, 0), nullif(elapsed, 0)) / metres * 1000, 6) END AS pace,
  CASE WHEN metres > 0 THEN CASE WHEN nullif(moving, 0) IS NOT NULL THEN 'moving' WHEN nullif(timer, 0) IS NOT NULL THEN 'timer' WHEN nullif(elapsed, 0) IS NOT NULL THEN 'elapsed' END END AS basis
FROM (SELECT c_custkey, c_acctbal AS metres, (c_custkey % 3)::DOUBLE AS moving, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 5)::DOUBLE END AS timer, (c_custkey % 7)::DOUBLE AS elapsed FROM customer)""")
def pace_ladder(spark, sf_dir):
    k, metres = F.col("c_custkey"), F.col("c_acctbal")
    times = {"moving": (k % 3).cast("double"), "timer": F.when(k % 2 == 0, (k % 5).cast("double")), "elapsed": (k % 7).cast("double")}
    rungs = [F.when(seconds != 0, F.struct(seconds.alias("seconds"), F.lit(name).alias("basis"))) for name, seconds in times.items()]
    rows = table(spark, sf_dir, "customer").withColumn("rung", F.when(metres > 0, F.coalesce(*rungs)))
    return rows.select("c_custkey", F.round(F.col("rung.seconds") / F.when(metres > 0, metres) * 1000, 6).alias("pace"), F.col("rung.basis").alias("basis"))


@query("""SELECT p_partkey, p_retailprice / 100 AS speed, 1000 / (p_retailprice / 100) AS pace,
  (floor(1000 / (p_retailprice / 100) + 0.5)::BIGINT // 60) || ':' || lpad((floor(1000 / (p_retailprice / 100) + 0.5)::BIGINT % 60)::VARCHAR, 2, '0') AS text
FROM part WHERE p_retailprice > 0""")
def pace_text(spark, sf_dir):
    speed = F.col("p_retailprice") / 100
    pace = scalar.pace_seconds(speed)
    return table(spark, sf_dir, "part").where("p_retailprice > 0").select("p_partkey", speed.alias("speed"), pace.alias("pace"), scalar.format_pace(pace).alias("text"))


@query("""SELECT s_suppkey, round(12742000 * asin(sqrt(least(1, sin(radians(lat2 - lat1) / 2) ** 2 + cos(radians(lat1)) * cos(radians(lat2)) * sin(radians(lon2 - lon1) / 2) ** 2))), 3) AS metres
FROM (SELECT s_suppkey, (s_suppkey % 120 - 60)::DOUBLE AS lat1, (s_suppkey * 7 % 300 - 150)::DOUBLE AS lon1, (s_nationkey * 3 - 30)::DOUBLE AS lat2, (s_nationkey * 11 - 100)::DOUBLE AS lon2 FROM supplier)""")
def haversine(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    d = lambda c: c.cast("double")
    metres = scalar.haversine(d(k % 120 - 60), d(k * 7 % 300 - 150), d(n * 3 - 30), d(n * 11 - 100), clamp=True)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(metres, 3).alias("metres"))


@query(f"""SELECT user_id, round(sum(value * least(dt, 600000000) / 1000000.0) / 1000, 6) AS work_kj,
  round(sum(least(dt, 600000000) / 60000000.0 * least(1, greatest(0, (value - 50) / 140.0)) * 0.64 * exp(1.92 * least(1, greatest(0, (value - 50) / 140.0)))), 6) AS trimp
FROM (SELECT *, lead(t) OVER ({_W}) - t AS dt FROM {_E}) WHERE dt > 0 GROUP BY user_id""")
def work_and_trimp(spark, sf_dir):
    steps = series.pairwise_dt(records(spark, sf_dir), KEY, ORDER).where("dt > 0")
    seconds = series.capped_time(F.col("dt"), 600)
    hrr = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("value") - 50) / 140.0))
    return steps.groupBy("user_id").agg(
        F.round(F.sum(F.col("value") * seconds) / 1000, 6).alias("work_kj"),
        F.round(F.sum(seconds / 60 * hrr * 0.64 * F.exp(1.92 * hrr)), 6).alias("trimp"),
    )


@query("""WITH RECURSIVE d AS (SELECT ts::DATE AS day, sum(value) AS load FROM events GROUP BY 1),
s AS (SELECT row_number() OVER (ORDER BY day) AS i, day, coalesce(load, 0.0) AS load
      FROM (SELECT unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM d) LEFT JOIN d USING (day)),
r AS (SELECT i, day, load, load * (1 - exp(-1 / 42.0)) AS f, load * (1 - exp(-1 / 7.0)) AS g, 0.0::DOUBLE AS form FROM s WHERE i = 1
  UNION ALL SELECT s.i, s.day, s.load, r.f * exp(-1 / 42.0) + s.load * (1 - exp(-1 / 42.0)), r.g * exp(-1 / 7.0) + s.load * (1 - exp(-1 / 7.0)), r.f - r.g
  FROM r JOIN s ON s.i = r.i + 1)
SELECT day::VARCHAR AS day, round(load, 4) AS load, round(f, 4) AS fitness, round(g, 4) AS fatigue, round(form, 4) AS form FROM r""")
def fitness_form(spark, sf_dir):
    daily = records(spark, sf_dir).select(F.to_date("ts").alias("day"), "value", F.lit("all").alias("who"))
    out = series.fitness(daily, ["who"], "day", "value")
    return out.select(F.col("day").cast("string").alias("day"), *(F.round(c, 4).alias(c) for c in ("load", "fitness", "fatigue", "form")))


@query(f"""WITH RECURSIVE e AS (SELECT user_id, value::DOUBLE AS v, row_number() OVER ({_W}) AS n FROM {_E} WHERE value IS NOT NULL),
r AS (SELECT user_id, n, v AS ref, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, CASE WHEN abs(e.v - ref) >= 3 THEN e.v ELSE ref END, up + CASE WHEN e.v - ref >= 3 THEN e.v - ref ELSE 0 END, down + CASE WHEN ref - e.v >= 3 THEN ref - e.v ELSE 0 END
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, round(max(up), 4) AS ascent, round(max(down), 4) AS descent FROM r GROUP BY user_id""")
def ascent_hysteresis(spark, sf_dir):
    found = series.ascent(records(spark, sf_dir), KEY, ORDER, "value")
    return found.select("user_id", F.round("ascent", 4).alias("ascent"), F.round("descent", 4).alias("descent"))


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 4""")
def first_of_each(spark, sf_dir):
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id"))
    return records(spark, sf_dir).withColumn("rn", rn).where("rn <= 4").select("user_id", "event_id", "value")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 50")
def inspect_limit(spark, sf_dir):
    return records(spark, sf_dir).orderBy(F.col("value").desc(), "event_id").limit(50).select("event_id", "value")


@query("SELECT 'region' AS part, r_name AS name FROM region UNION ALL SELECT 'nation', n_name FROM nation")
def union_parts(spark, sf_dir):
    a = table(spark, sf_dir, "region").select(F.lit("region").alias("part"), F.col("r_name").alias("name"))
    return a.unionByName(table(spark, sf_dir, "nation").select(F.lit("nation").alias("part"), F.col("n_name").alias("name")))


@query("""SELECT o_orderkey, o_orderstatus || '_' || o_custkey % 3 AS code FROM orders WHERE o_orderstatus || '_' || o_custkey % 3 NOT IN ('F_0', 'O_1', 'O_2')""")
def except_codes(spark, sf_dir):
    """Findings that no remedy covers."""
    found = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("_", "o_orderstatus", (F.col("o_custkey") % 3).cast("string")).alias("code"))
    return matching.unresolved(found, spark.sql("SELECT * FROM VALUES ('F_0', 1, 'repair'), ('O_1', 2, 'edit'), ('O_2', 2, 'edit') AS t(code, priority, command)"))


@query("""SELECT o_orderkey, o_orderstatus || '_' || o_custkey % 3 AS code FROM orders WHERE o_orderstatus || '_' || o_custkey % 3 IN ('F_0', 'O_1', 'O_2')""")
def repairable_codes(spark, sf_dir):
    """Findings that some remedy covers."""
    found = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("_", "o_orderstatus", (F.col("o_custkey") % 3).cast("string")).alias("code"))
    known = spark.sql("SELECT * FROM VALUES ('F_0', 1, 'repair'), ('O_1', 2, 'edit'), ('O_2', 2, 'edit') AS t(code, priority, command)")
    return matching.remedies(found, known).where("command IS NOT NULL").select("o_orderkey", "code")


_CHECKS = {"NO_LINES": "n = 0", "HIGH_TOTAL": "o_totalprice > 200000", "NOT_FINAL": "o_orderstatus <> 'F'"}
_REMEDY = {"NO_LINES": (1, "repair"), "NOT_FINAL": (2, "edit")}


@query("""SELECT code, count(*) AS n, min(o_orderkey) AS first_key FROM (
  SELECT o_orderkey, unnest([CASE WHEN n = 0 THEN 'NO_LINES' END, CASE WHEN o_totalprice > 200000 THEN 'HIGH_TOTAL' END, CASE WHEN o_orderstatus <> 'F' THEN 'NOT_FINAL' END]) AS code
  FROM (SELECT o.*, coalesce(d.n, 0) AS n FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) d ON l_orderkey = o_orderkey))
WHERE code IS NOT NULL GROUP BY code""")
def validate_flags(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, sf_dir, "orders").join(counts, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    flags = F.array_compact(F.array(*[F.when(F.expr(test), code) for code, test in _CHECKS.items()]))
    found = o.select("o_orderkey", F.explode(flags).alias("code"))
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@query("""WITH o AS (SELECT o.*, coalesce(d.n, 0) AS n FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) d ON l_orderkey = o_orderkey),
f AS (SELECT o_orderkey, 'NO_LINES' AS code FROM o WHERE n = 0 UNION ALL SELECT o_orderkey, 'HIGH_TOTAL' FROM o WHERE o_totalprice > 200000
      UNION ALL SELECT o_orderkey, 'NOT_FINAL' FROM o WHERE o_orderstatus <> 'F')
SELECT o_orderkey, code, priority, command FROM f LEFT JOIN (VALUES ('NO_LINES', 1, 'repair'), ('NOT_FINAL', 2, 'edit')) r(code, priority, command) USING (code)""")
def doctor_remedies(spark, sf_dir):
    counts = _derived(spark, sf_dir).select(F.col("k").alias("o_orderkey"), "n")
    o = table(spark, sf_dir, "orders").join(counts, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    flags = F.array_compact(F.array(*[F.when(F.expr(test), code) for code, test in _CHECKS.items()]))
    known = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{code}', {p}, '{verb}')" for code, (p, verb) in _REMEDY.items()) + " AS t(code, priority, command)")
    return matching.remedies(o.select("o_orderkey", F.explode(flags).alias("code")), known).select("o_orderkey", "code", "priority", "command")
