"""What is doubtful about activities: sensors, summaries, laps, lengths, times and positions.

Checks only tell; values stay as they are. Only ``gated_positions`` takes positions away that can't be,
and a forensic reader keeps even those. A row of findings is (file_id, part, session, code, value), where
session is null if a code is about the part, and value is the count, length or amount that the code names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import haversine
from ..operators import series
from . import activity
from .activity import ORDER, OWN, PART

#: Highest plausible heart rate and power, repeats of a dead heart-rate sensor.
MAX_HR, MAX_POWER, FLATLINE = 230, 2500, 120
#: Steps and speed of a frozen distance, share of a session that laps should cover.
FROZEN_STEPS, FROZEN_MPS, LEAST_LAPS = 30, 2.0, 0.9
#: Shortest active length (s), and pools (m).
LEAST_LENGTH_S, POOLS_M = 2.0, (15.0, 55.0)
#: 2010-01-01, a week, and the widest offset of a local time, in microseconds.
FIRST_SOUND, WEEK, WIDEST_OFFSET = 1_262_304_000 * series.MICROS, 7 * 86_400 * series.MICROS, 26 * 3600 * series.MICROS
#: Speeds (m/s) that no one reaches, by sport, and for all others.
CEILINGS = {"running": 12.5, "walking": 8.0, "hiking": 8.0, "swimming": 4.0, "cycling": 42.0}
CEILING = 55.0
#: Maker and kind of rides in worlds that don't exist, difference of a pair of fields that is one too many.
VIRTUAL_MAKER, VIRTUAL_SUB_SPORT, PAIR_TOLERANCE = 260, 58, 0.01


def _row(df: DataFrame, code: str, value: Column, own: bool = True) -> DataFrame:
    session = F.col("session").cast("int") if own else F.lit(None).cast("int")
    return df.select(*PART, session.alias("session"), F.lit(code).alias("code"), value.cast("double").alias("value"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _counted(rows: DataFrame, keys: list[str], counts: dict[str, Column], own: bool = True) -> DataFrame:
    """A finding for each count that isn't 0; one aggregation serves all."""
    wide = rows.groupBy(*keys).agg(*(F.count_if(condition).alias(code) for code, condition in counts.items()))
    long = wide.unpivot(keys, [F.col(c) for c in counts], "code", "value").where("value > 0")
    session = F.col("session").cast("int") if own else F.lit(None).cast("int")
    return long.select(*PART, session.alias("session"), "code", F.col("value").cast("double").alias("value"))


def sensors(owned: DataFrame, held: DataFrame) -> DataFrame:
    """Values that can't be, sensors that stand still, distances that fall or don't grow."""
    frozen = owned.where(F.col("distance").isNotNull()).join(held.where("sport <> 'swimming'").select(*OWN), OWN, "left_semi")
    still = (F.col("distance") == F.lag("distance").over(series.over(OWN, ORDER))) & (F.col("speed") > FROZEN_MPS)
    frozen = frozen.withColumn("still", F.coalesce(still, F.lit(False)))
    frozen = series.longest_run(frozen, OWN, ORDER, F.when(F.col("still"), F.lit(1))).where(F.col("longest") >= FROZEN_STEPS)
    flat = series.longest_run(owned, OWN, ORDER, F.col("heart_rate")).where(F.col("longest") > FLATLINE)
    resets = series.resets(owned, OWN, ORDER, "distance")
    return _union([
        _counted(owned, OWN, {"HR_IMPLAUSIBLE": F.col("heart_rate") > MAX_HR, "POWER_IMPLAUSIBLE": F.col("power") > MAX_POWER}),
        _row(flat, "HR_FLATLINE", F.col("longest")),
        _row(frozen, "DISTANCE_FROZEN", F.col("longest")),
        _row(resets.where("decreases > 0"), "DISTANCE_DECREASES", F.col("decreases")),
        _row(resets.where("resets > 0"), "DISTANCE_RESET", F.col("resets")),
    ])


def summaries(owned: DataFrame, held: DataFrame) -> DataFrame:
    """Declared totals that contradict themselves, or the records."""
    derived = activity.derived_totals(owned)
    both = held.join(derived.select(*OWN, "n_records", "distance_m", "avg_speed"), OWN, "left")
    d = lambda name: F.col(f"declared.{name}")
    count = lambda conditions: sum((F.coalesce(c.cast("int"), F.lit(0)) for c in conditions), F.lit(0))
    over = count(d(f"avg_{s}") > d(f"max_{s}") for s in ("heart_rate", "power", "speed"))
    negative = count(d(t) < 0 for t in ("elapsed_time_s", "timer_time_s", "distance_m"))
    return _union([
        _row(both.where(over > 0), "SUMMARY_AVG_EXCEEDS_MAX", over),
        _row(both.where(negative > 0), "SUMMARY_NEGATIVE_TOTAL", negative),
        _row(both.where((d("elapsed_time_s") == 0) & (F.col("n_records") > 0)), "ZERO_DURATION_SESSION", F.col("n_records")),
        _row(both.where((F.col("avg_speed") > 1) & (F.coalesce("distance_m", F.lit(0.0)) < 1)), "MOVEMENT_WITHOUT_DISTANCE", F.col("avg_speed")),
    ])


def laps_and_lengths(owned: DataFrame, messages: DataFrame, held: DataFrame) -> DataFrame:
    """Laps without time or that leave out much of a session; lengths too short, pools that there aren't."""
    laps = activity.laps(messages, held)
    spans = owned.groupBy(*OWN).agg(((F.max("t") - F.min("t")) / series.MICROS).alias("elapsed_s"))
    covered = laps.groupBy(*OWN).agg(F.sum(F.coalesce("elapsed_s", F.lit(0.0))).alias("covered")).join(spans, OWN)
    covered = covered.where("elapsed_s > 0").where(F.col("covered") < LEAST_LAPS * F.col("elapsed_s"))
    lengths = activity.lengths(messages, held).where("active")
    pools = lengths.groupBy(*OWN).agg(F.count(F.lit(1)).alias("n")).join(held.select(*OWN, "declared.distance_m"), OWN)
    pools = pools.withColumn("pool", F.col("distance_m") / F.col("n")).where(~F.col("pool").between(*POOLS_M))
    return _union([
        _counted(laps, OWN, {"LAP_ZERO_DURATION": F.col("elapsed_s") == 0}),
        _row(covered, "LAP_COVERAGE_GAP", F.col("covered")),
        _counted(lengths, OWN, {"POOL_ZERO_LENGTH": F.col("elapsed_s") < LEAST_LENGTH_S}),
        _row(pools, "POOL_LENGTH_IMPLAUSIBLE", F.col("pool")),
    ])


def parts(messages: DataFrame) -> DataFrame:
    """Times and counts of a whole part: clocks that were wrong, order, what the summary of all says or lacks."""
    rows = activity.records(messages)
    micros = lambda name: F.get_json_object("fields", f"$.{name}").cast("long") * series.MICROS
    spans = rows.groupBy(*PART).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    made = messages.where("global_num = 0").groupBy(*PART).agg(F.min_by(micros("time_created"), "msg_seq").alias("created"))
    late = spans.join(made, PART).where(F.col("b") > F.col("created") + WEEK)
    moved = series.stable_order(rows, PART, "i").where("moved")
    whole = messages.where("global_num = 34").groupBy(*PART).agg(
        F.min_by(F.struct(
            micros("timestamp").alias("t"), micros("local_timestamp").alias("local"),
            F.get_json_object("fields", "$.num_sessions").cast("int").alias("n"),
        ), "msg_seq").alias("x")
    )
    held = messages.where("global_num = 18").groupBy(*PART).agg(F.count(F.lit(1)).alias("n_sessions"))
    counted = whole.join(held, PART, "left").withColumn("n_sessions", F.coalesce("n_sessions", F.lit(0)))
    lacking = rows.select(*PART).distinct().join(whole, PART, "left_anti")
    return _union([
        _row(spans.where(F.col("a") < FIRST_SOUND), "UNRELIABLE_ABSOLUTE_TIME", F.col("a") / series.MICROS, False),
        _row(late, "TIMESTAMPS_AFTER_CREATION", (F.col("b") - F.col("created")) / series.MICROS, False),
        _row(moved.groupBy(*PART).count(), "RECORDS_REORDERED", F.col("count"), False),
        _row(lacking, "ACTIVITY_MESSAGE_MISSING", F.lit(1), False),
        _row(counted.where("x.n <> n_sessions"), "NUM_SESSIONS_MISMATCH", F.col("n_sessions"), False),
        _row(whole.where(F.abs(F.col("x.local") - F.col("x.t")) > WIDEST_OFFSET), "LOCAL_TIMESTAMP_IMPLAUSIBLE", (F.col("x.local") - F.col("x.t")) / series.MICROS, False),
    ])


def pairs(messages: DataFrame) -> DataFrame:
    """Fields that a record holds twice, with values that differ."""
    number = lambda name: F.get_json_object("fields", f"$.{name}").cast("double")
    differ = lambda s: F.abs(number(f"enhanced_{s}") - number(s)) > PAIR_TOLERANCE
    rows = messages.where("global_num = 20")
    return _counted(rows, PART, {"ENHANCED_PAIR_DISAGREES": differ("speed") | differ("altitude")}, own=False)


def outside(owned: DataFrame, held: DataFrame) -> DataFrame:
    """Records that no session holds, of parts with several sessions."""
    several = held.groupBy(*PART).count().where("count > 1").select(*PART)
    return _counted(owned.join(several, PART, "left_semi"), PART, {"RECORDS_OUTSIDE_SESSIONS": ~F.col("inside")}, own=False)


def virtual_sessions(messages: DataFrame, held: DataFrame) -> DataFrame:
    """The sessions of worlds that don't exist; their positions are not judged."""
    raw = lambda name: F.get_json_object("fields", f"$.{name}")
    made = messages.where("global_num = 0").where(raw("manufacturer") == VIRTUAL_MAKER).select(*PART).distinct()
    rides = messages.where("global_num = 18").where(raw("sub_sport") == VIRTUAL_SUB_SPORT).select(*PART).distinct()
    return held.select(*OWN).join(made.union(rides).distinct(), PART, "left_semi")


def judged_positions(owned: DataFrame, messages: DataFrame, held: DataFrame) -> DataFrame:
    """Adds null_island (both degrees exactly 0) and spike (reached and left faster than the sport allows, while its
    neighbours fit each other). Neighbours are the valid fixes before and after, as they were recorded."""
    both = owned.join(held.select(*OWN, "sport"), OWN, "left")
    both = both.join(virtual_sessions(messages, held).withColumn("virtual", F.lit(True)), OWN, "left")
    zero = F.coalesce((F.col("position_lat") == 0) & (F.col("position_long") == 0), F.lit(False))
    both = both.withColumn("virtual", F.coalesce("virtual", F.lit(False))).withColumn("null_island", zero & ~F.col("virtual"))
    fix = F.col("position_lat").isNotNull() & F.col("position_long").isNotNull() & F.col("t").isNotNull() & ~zero
    w = series.over([*OWN, "fix"], ORDER)
    near = lambda f, tag: {f"{tag}_{c}": f(c).over(w) for c in ("position_lat", "position_long", "t")}
    both = both.withColumn("fix", fix).withColumns(near(F.lag, "a") | near(F.lead, "b"))
    at = lambda tag: (F.col(f"{tag}position_lat"), F.col(f"{tag}position_long"), F.col(f"{tag}t"))

    def speed(x: str, y: str) -> Column:
        (la, lo, t), (lb, ob, u) = at(x), at(y)
        return haversine(la, lo, lb, ob, clamp=True) * series.MICROS / F.when(u > t, u - t)

    ceiling = F.coalesce(F.create_map(*[F.lit(x) for pair in CEILINGS.items() for x in pair])[F.col("sport")], F.lit(CEILING))
    bounce = (speed("a_", "") > ceiling) & (speed("", "b_") > ceiling) & (speed("a_", "b_") <= ceiling)
    spike = F.col("fix") & ~F.col("virtual") & F.coalesce(bounce, F.lit(False))
    return both.withColumn("spike", spike).select(*owned.columns, "null_island", "spike")


def gated_positions(judged: DataFrame, mode: str = "lenient") -> DataFrame:
    """Records without positions that can't be; a forensic reader keeps them and has the flags."""
    if mode == "forensic":
        return judged
    bad = F.col("null_island") | F.col("spike")
    return judged.withColumns({c: F.when(~bad, F.col(c)) for c in ("position_lat", "position_long")})


def positions(judged: DataFrame) -> DataFrame:
    return _counted(judged, OWN, {"NULL_ISLAND": F.col("null_island"), "GPS_SPIKES": F.col("spike")})


def findings(messages: DataFrame, held: DataFrame | None = None, owned: DataFrame | None = None) -> DataFrame:
    """All findings of all parts and sessions. ``held`` and ``owned`` spare making sessions and owners anew."""
    if held is None or owned is None:
        held, owned = activity.kept(messages)
    return _union([
        sensors(owned, held), summaries(owned, held), laps_and_lengths(owned, messages, held), parts(messages), pairs(messages),
        outside(owned, held), positions(judged_positions(owned, messages, held)),
    ])
