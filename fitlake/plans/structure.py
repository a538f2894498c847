"""The structure of workouts that nobody described: work and recovery, repeats of intervals, and insights.

Bands are found with windows. Only the few runs of a session are folded in order (they depend on what
came before), one session at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import series
from . import activity
from .activity import ORDER, OWN, PART
from .keep import keep

#: Shortest work and recovery (s), fewest repeats and samples, widest spread of durations, tolerances of repeats.
LEAST_S = {"work": 20.0, "recovery": 15.0}
LEAST_REPEATS = 3
LEAST_SAMPLES = 11
MAX_DURATION_CV = 0.40
DURATION_TOLERANCE = 0.25
INTENSITY_TOLERANCE = 0.10
#: Percents that make an insight, and fewest samples of a half.
SPLIT_PCT = 2.0
DRIFT_PCT = 5.0
COASTING_PCT = 25.0
LEAST_HALF = 60
#: Kinds of interval by the intensity of a workout's step, shares of the reference of work and recovery, rest that ends a swim.
STEP_KINDS = {"active": "work", "interval": "work", "rest": "rest", "recovery": "recovery", "warmup": "warmup", "cooldown": "cooldown"}
WORK_BAND, RECOVERY_BAND = 1.10, 0.85
SET_REST_S = 10
#: Sports whose effort is judged by power where there is any.
BY_POWER = ("cycling", "rowing")

_INTERVALS = "session_intervals array<struct<kind:string,first_t:long,last_t:long,duration_s:double,intensity:double,repeat:int>>"


def bands(owned: DataFrame, signal: str) -> DataFrame:
    """Records with a signal, smoothed, with the state (work or recovery) that they are in."""
    smooth = series.rolling_median(owned.where(F.col(signal).isNotNull() & F.col("t").isNotNull()), OWN, ORDER, signal)
    both = smooth.join(series.band_reference(smooth, OWN, "smooth"), OWN)
    return series.hysteresis_bands(both, OWN, ORDER, "smooth", "reference")


def merge_runs(runs: list[dict]) -> list[dict]:
    """Runs in order without stubs: a short one joins the run before it (a leading one is recovery), equal neighbours become one."""
    out: list[dict] = []
    for run in runs:
        run = dict(run)
        if (run["last_t"] - run["first_t"]) / series.MICROS < LEAST_S[run["kind"]]:
            run["kind"] = out[-1]["kind"] if out else "recovery"
        if out and out[-1]["kind"] == run["kind"]:
            before = out[-1]
            n = before["n"] + run["n"]
            before |= {"last_t": run["last_t"], "intensity": (before["intensity"] * before["n"] + run["intensity"] * run["n"]) / n, "n": n}
        else:
            out.append(run)
    return out


def _known(x) -> bool:
    return x is not None and x == x


def alike(a: dict, b: dict) -> bool:
    """Whether two pieces of work repeat each other: swims by their lengths, others by duration and intensity (if known)."""
    if _known(a.get("lengths")) and _known(b.get("lengths")):
        return a["lengths"] == b["lengths"]

    def near(name: str, tolerance: float) -> bool:
        return abs(a[name] - b[name]) <= tolerance * max(a[name], b[name])

    if not (_known(a["duration_s"]) and _known(b["duration_s"])) or max(a["duration_s"], b["duration_s"]) <= 0 or not near("duration_s", DURATION_TOLERANCE):
        return False
    both = _known(a["intensity"]) and _known(b["intensity"])
    return not both or max(a["intensity"], b["intensity"]) <= 0 or near("intensity", INTENSITY_TOLERANCE)


def group_repeats(intervals: list[dict]) -> list[dict]:
    """Adds repeat to work: a number for neighbours that are alike. Each is compared with the first of its group."""
    anchor, number = None, 0
    for x in intervals:
        x["repeat"] = None
        if x["kind"] != "work":
            continue
        if anchor is None or not alike(anchor, x):
            anchor, number = x, number + 1
        x["repeat"] = number
    return intervals


def intervals(owned: DataFrame, signal: str) -> DataFrame:
    """One row per interval of the sessions that have a clear structure: index (from 1), kind, first_t, last_t,
    duration_s, intensity (mean of the signal), repeat. Sessions without one have no rows."""
    banded = bands(owned, signal)
    w = series.over(OWN, ORDER)
    new = (~F.col("state").eqNullSafe(F.lag("state").over(w))).cast("int")
    runs = (
        banded.withColumn("new", new)
        .withColumn("run", F.sum("new").over(w))
        .groupBy(*OWN, "run", F.col("state").alias("kind"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.avg(signal).alias("intensity"))
    )
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in owned.select(*OWN).schema)

    def fold(held: pd.DataFrame) -> pd.DataFrame:
        ordered = held.sort_values("run")
        merged = merge_runs(ordered[["kind", "n", "first_t", "last_t", "intensity"]].to_dict("records"))
        for x in merged:
            x["duration_s"] = (x["last_t"] - x["first_t"]) / series.MICROS
        lengths = pd.Series([x["duration_s"] for x in merged if x["kind"] == "work"], dtype=float)
        clear = len(lengths) >= LEAST_REPEATS and lengths.std(ddof=0) <= MAX_DURATION_CV * lengths.mean() and ordered["n"].sum() >= LEAST_SAMPLES
        names = ("kind", "first_t", "last_t", "duration_s", "intensity", "repeat")
        found = [{k: x[k] for k in names} for x in group_repeats(merged)] if clear else []
        return pd.DataFrame([{**{k: ordered[k].iloc[0] for k in OWN}, "session_intervals": found}])

    folded = runs.groupBy(*OWN).applyInPandas(fold, f"{keys}, {_INTERVALS}")
    rows = folded.select(*OWN, F.posexplode("session_intervals").alias("at", "x"))
    return rows.select(*OWN, (F.col("at") + 1).alias("index"), "x.*")


def with_signal(owned: DataFrame, held: DataFrame) -> DataFrame:
    """Adds signal: power in sports that are judged by it, if the session has any, else speed; and signal_name."""
    powered = owned.groupBy(*OWN).agg((F.count("power") > 0).alias("powered")).join(held.select(*OWN, "sport"), OWN, "left")
    by_power = F.col("powered") & F.col("sport").isin(*BY_POWER)
    named = powered.select(*OWN, F.when(by_power, "power").otherwise("speed").alias("signal_name"))
    both = owned.join(named, OWN)
    return both.withColumn("signal", F.when(F.col("signal_name") == "power", F.col("power")).otherwise(F.col("speed")))


def lap_intervals(owned: DataFrame, messages: DataFrame, from_records: bool = False, held: DataFrame | None = None) -> DataFrame:
    """Intervals of the sessions whose laps say the structure: a workout's steps, else two laps or more by hand.

    ``owned`` has signal. Intensities are the laps' own averages, or with ``from_records`` those of the records
    from a lap's start up to (not with) its end, where there are any. The kind comes from the step's intensity,
    else from the share of the reference.
    """
    laps = activity.laps(messages, held)
    basis = laps.groupBy(*OWN).agg(
        F.when(F.count("step_index") > 0, "steps:workout").when(F.count_if(F.col("trigger") == "manual") >= 2, "laps:manual").alias("basis")
    ).where("basis IS NOT NULL")
    names = owned.select(*OWN, "signal_name").distinct()
    used = laps.join(basis, OWN).join(names, OWN, "left")
    said = F.when(F.col("signal_name") == "power", F.col("avg_power")).otherwise(F.col("avg_speed"))
    used = used.withColumn("intensity", said)
    if from_records:
        spans = used.select(*OWN, F.col("i").alias("lap"), F.col("t").alias("a"), (F.col("t") + F.col("elapsed_s") * series.MICROS).cast("long").alias("b"))
        on = [owned[k] == spans[k] for k in OWN] + [owned["t"] >= spans["a"], owned["t"] < spans["b"]]
        inside = spans.join(owned, on).groupBy(*(spans[k] for k in OWN), spans["lap"]).agg(F.avg("signal").alias("measured"))
        used = used.join(inside.withColumnRenamed("lap", "i"), [*OWN, "i"], "left").withColumn("intensity", F.coalesce("measured", "intensity"))
    steps = messages.where("global_num = 27").select(
        *PART, F.get_json_object("fields", "$.message_index").cast("int").alias("step_index"), "msg_seq",
        F.get_json_object("fields", "$.intensity").alias("step_intensity"),
    ).where("step_index IS NOT NULL AND step_intensity IS NOT NULL")
    steps = steps.groupBy(*PART, "step_index").agg(F.max_by("step_intensity", "msg_seq").alias("step_intensity"))
    used = used.join(steps, [*PART, "step_index"], "left").join(series.band_reference(used, OWN, "intensity"), OWN, "left")
    ratio = F.col("intensity") / F.when(F.col("reference") > 0, F.col("reference"))
    relative = F.when(ratio >= WORK_BAND, "work").when(ratio <= RECOVERY_BAND, "recovery").otherwise("steady")
    step = F.coalesce(F.create_map(*[F.lit(x) for pair in STEP_KINDS.items() for x in pair])[F.col("step_intensity")], F.lit("steady"))
    kind = F.when((F.col("basis") == "steps:workout") & F.col("step_index").isNotNull(), step).otherwise(relative)
    return used.select(
        *OWN, "basis", F.col("i").alias("place"), kind.alias("kind"), F.col("t").alias("first_t"),
        (F.col("t") + F.col("elapsed_s") * series.MICROS).cast("long").alias("last_t"),
        F.coalesce(F.nullif("timer_s", F.lit(0.0)), "elapsed_s").alias("duration_s"), "distance_m", "intensity",
        F.lit(None).cast("long").alias("lengths"), "step_index",
    )


def swim_intervals(owned: DataFrame, messages: DataFrame, held: DataFrame) -> DataFrame:
    """Swims of pool sessions: active lengths with less than 10 s at the wall between them; a rest that isn't known ends a swim."""
    lengths = activity.lengths(messages, held).where("active").join(held.where("sport = 'swimming'").select(*OWN, F.col("declared.distance_m").alias("said_m")), OWN)
    pool = messages.where("global_num = 18").select(*PART, "msg_seq", F.get_json_object("fields", "$.pool_length").cast("double").alias("pool"))
    pool = pool.where("pool > 0").groupBy(*PART).agg(F.min_by("pool", "msg_seq").alias("pool"))
    swum = activity.derived_totals(owned).select(*OWN, F.col("distance_m").alias("swum_m"))
    w = series.over(OWN, ["i"])
    rest = (F.col("t") - F.lag("end_t").over(w)) / series.MICROS
    new = F.coalesce((rest >= SET_REST_S).cast("int"), F.lit(1))
    sets = lengths.withColumn("new", new).withColumn("place", F.sum("new").over(w)).groupBy(*OWN, "place").agg(
        F.min_by("t", "i").alias("first_t"), F.max_by("end_t", "i").alias("last_t"), F.sum("elapsed_s").alias("spent"),
        F.count(F.lit(1)).alias("lengths"), F.first("said_m").alias("said_m"),
    )
    all_lengths = lengths.groupBy(*OWN).agg(F.count(F.lit(1)).alias("n"))
    sets = sets.join(all_lengths, OWN).join(pool, PART, "left").join(swum, OWN, "left")
    one = F.coalesce("pool", F.coalesce(F.nullif("swum_m", F.lit(0.0)), "said_m") / F.col("n"))
    span = (F.col("last_t") - F.col("first_t")) / series.MICROS
    sets = sets.withColumn("distance_m", one * F.col("lengths")).withColumn("duration_s", F.coalesce(F.nullif("spent", F.lit(0.0)), span))
    return sets.select(
        *OWN, F.lit("lengths:sets").alias("basis"), "place", F.lit("work").alias("kind"), "first_t", "last_t", "duration_s", "distance_m",
        (F.col("distance_m") / F.when(F.col("duration_s") > 0, F.col("duration_s"))).alias("intensity"), "lengths",
        F.lit(None).cast("int").alias("step_index"),
    )


def structure(messages: DataFrame, from_records: bool = False) -> DataFrame:
    """One row per interval of each session with a structure, by the best evidence there is: laps (of a workout's
    steps, or by hand), swims of a pool, else bands of power or speed. ``basis`` names it. Sessions without have no rows."""
    held, owned = activity.kept(messages)
    owned = with_signal(owned, held)
    told = keep(lap_intervals(owned, messages, from_records, held), "laps")
    swims = swim_intervals(owned, messages, held).join(told.select(*OWN).distinct(), OWN, "left_anti")
    told = keep(told.unionByName(swims), "told")
    silent = owned.join(told.select(*OWN).distinct(), OWN, "left_anti")
    named = silent.select(*OWN, F.concat(F.lit("detected:"), "signal_name", F.lit("-steps")).alias("basis")).distinct()
    found = intervals(silent, "signal").join(named, OWN).select(
        *OWN, "basis", F.col("index").cast("long").alias("place"), "kind", "first_t", "last_t", "duration_s",
        F.lit(None).cast("double").alias("distance_m"), "intensity", F.lit(None).cast("long").alias("lengths"), F.lit(None).cast("int").alias("step_index"),
    )
    rows = told.unionByName(found)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("place").schema)

    def number(session: pd.DataFrame) -> pd.DataFrame:
        ordered = session.sort_values("place")
        records = group_repeats(ordered.drop(columns="place").astype(object).where(ordered.drop(columns="place").notna(), None).to_dict("records"))
        return pd.DataFrame(records).assign(index=range(1, len(records) + 1))

    # Only intervals are handed to Python, a session at a time.
    return rows.groupBy(*OWN).applyInPandas(number, f"{schema}, repeat int, index int")


def repeat_groups(found: DataFrame) -> DataFrame:
    """Repeats of work (two and more alike): count, mean duration, mean intensity, mean recovery after each but the last."""
    w = series.over(OWN, ["index"])
    rest = F.when(F.lead("kind").over(w) == "recovery", F.lead("duration_s").over(w))
    work = found.withColumn("rest_s", rest).where("kind = 'work'")
    last = F.lead("repeat").over(series.over(OWN, ["index"])).eqNullSafe(F.col("repeat"))
    work = work.withColumn("rest_s", F.when(last, F.col("rest_s")))
    return (
        work.groupBy(*OWN, "repeat")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("duration_s").alias("duration_s"), F.avg("intensity").alias("intensity"), F.avg("rest_s").alias("rest_s"))
        .where("n >= 2")
    )


def insights(owned: DataFrame, sports: DataFrame, signal: str = "speed", repeats: DataFrame | None = None) -> DataFrame:
    """(keys, code, value): splits by speed, drift of ``signal`` over heart rate, coasting on rides, and the repeats of
    a session's largest group. ``sports`` has the keys and sport, ``repeats`` is that of ``repeat_groups``."""
    row = lambda df, code, value: df.select(*OWN, code.alias("code"), value.cast("double").alias("value"))
    pace = series.halves(owned, OWN, ORDER, "speed", LEAST_HALF).where("first_half > 0")
    pace = pace.withColumn("pct", (F.col("second_half") / F.col("first_half") - 1) * 100)
    split: Column = F.when(F.col("pct") >= SPLIT_PCT, "PACING_NEGATIVE_SPLIT").when(F.col("pct") <= -SPLIT_PCT, "PACING_POSITIVE_SPLIT")
    drift = series.drift(owned, OWN, ORDER, signal, "heart_rate", LEAST_HALF).where(F.col("drift_pct") > DRIFT_PCT)
    rides = owned.join(sports.where("sport = 'cycling'").select(*OWN), OWN, "left_semi").groupBy(*OWN)
    rides = rides.agg(F.count("power").alias("n"), F.count_if(F.col("power") == 0).alias("zero")).where(F.col("n") >= LEAST_HALF)
    rides = rides.withColumn("pct", F.col("zero") / F.col("n") * 100).where(F.col("pct") >= COASTING_PCT)
    told = owned.select(*OWN).limit(0).withColumn("most", F.lit(0))
    if repeats is not None:
        told = repeats.groupBy(*OWN).agg(F.max("n").alias("most"))
    return (
        row(pace, split, F.col("pct")).where("code IS NOT NULL")
        .unionByName(row(told, F.lit("WORKOUT_STRUCTURE"), F.col("most")))
        .unionByName(row(drift, F.lit("HR_DRIFT_HIGH"), F.col("drift_pct")))
        .unionByName(row(rides, F.lit("COASTING_HIGH"), F.col("pct")))
    )
