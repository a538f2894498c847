"""Operators on ordered series: steps, gaps, runs, rolling values, states, splits, fitness.

Every operator takes the key columns of a series and its ordering columns as parameters, so it runs
on records of a workout as on any other table. Windows are always partitioned by the keys. Times
are whole microseconds (``t``), so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def over(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def pairwise_dt(df: DataFrame, keys: list[str], order: list[str], t: str = "t") -> DataFrame:
    """Adds dt: the next time less this one. A null time makes both its pairs null; nothing is bridged."""
    return df.withColumn("dt", F.lead(t).over(over(keys, order)) - F.col(t))


def capped_time(dt: Column, cap_s: float) -> Column:
    """Seconds of a step up to a cap; null where there is no step forward."""
    return F.when(dt > 0, F.least(dt, F.lit(int(cap_s * MICROS)))) / MICROS


def moving_time(df: DataFrame, keys: list[str], order: list[str], moving: Column, cap_s: float = 30) -> DataFrame:
    """Per series: seconds of capped steps that begin while moving."""
    steps = pairwise_dt(df.withColumn("moving", moving), keys, order).where("dt > 0 AND moving")
    return steps.groupBy(*keys).agg(F.sum(F.least("dt", F.lit(int(cap_s * MICROS)))).alias("moving_us"))


def classify_gaps(
    df: DataFrame, keys: list[str], order: list[str], stops: Column, min_s: float = 10, smart_s: float = 30
) -> DataFrame:
    """Gaps of at least ``min_s``: manual_stop if a stop lies at either end, then smart_recording, then unknown."""
    w = over(keys, order)
    steps = df.withColumn("stop", stops).withColumn("end_t", F.lead("t").over(w)).withColumn("end_stop", F.lead("stop").over(w))
    gaps = steps.withColumn("gap_us", F.col("end_t") - F.col("t")).where(F.col("gap_us") >= int(min_s * MICROS))
    kind = (
        F.when(F.col("stop") | F.col("end_stop"), "manual_stop")
        .when(F.col("gap_us") <= int(smart_s * MICROS), "smart_recording")
        .otherwise("unknown")
    )
    return gaps.select(*keys, "t", "end_t", "gap_us", kind.alias("kind"))


def stable_order(df: DataFrame, keys: list[str], sequence: str, t: str = "t") -> DataFrame:
    """Adds the carried time, the new position, and whether a row moved; untimed rows follow the row before them."""
    carried = df.withColumn("carried_t", F.last(t, ignorenulls=True).over(over(keys, [sequence])))
    placed = carried.withColumn(
        "position", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("carried_t").asc_nulls_first(), sequence))
    ).withColumn("was", F.row_number().over(over(keys, [sequence])))
    return placed.withColumn("moved", F.col("position") != F.col("was")).drop("was")


def runs(df: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """Runs of equal consecutive values (nulls break them): keys, run, value, n, first_t, last_t."""
    w = over(keys, order)
    marked = df.withColumn("v", value).withColumn(
        "new", (~F.coalesce(F.col("v") == F.lag("v").over(w), F.lit(False))).cast("int")
    )
    return (
        marked.withColumn("run", F.sum("new").over(w))
        .groupBy(*keys, "run", "v")
        .agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    )


def longest_run(df: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    return runs(df, keys, order, value).where("v IS NOT NULL").groupBy(*keys).agg(F.max("n").alias("longest"))


def resets(df: DataFrame, keys: list[str], order: list[str], value: str, below: float = 1, above: float = 10) -> DataFrame:
    """Per series: decreases and resets to nearly nothing, between values that are present."""
    present = df.where(F.col(value).isNotNull()).withColumn("before", F.lag(value).over(over(keys, order)))
    return present.groupBy(*keys).agg(
        F.count_if(F.col(value) < F.col("before")).alias("decreases"),
        F.count_if((F.col(value) < below) & (F.col("before") > above)).alias("resets"),
    )


def rolling_median(df: DataFrame, keys: list[str], order: list[str], value: str, width: int = 11) -> DataFrame:
    """Adds smooth: the median of a centred window, which is shorter at the ends."""
    half = width // 2
    held = F.sort_array(F.collect_list(value).over(over(keys, order).rowsBetween(-half, half)))
    n = F.size("held")
    middle = (F.get("held", F.floor((n - 1) / 2).cast("int")) + F.get("held", F.floor(n / 2).cast("int"))) / 2
    return df.withColumn("held", held).withColumn("smooth", middle).drop("held")


def band_reference(df: DataFrame, keys: list[str], value: str, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Per series: the middle between two order statistics of its positive values.

    A series (one workout) is gathered as one array.
    """
    held = df.where(F.col(value) > 0).groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("held"))
    at = lambda q: F.get("held", F.floor(F.lit(q) * (F.size("held") - 1)).cast("int"))
    return held.select(*keys, ((at(low) + at(high)) / 2).alias("reference"))


def hysteresis_bands(
    df: DataFrame, keys: list[str], order: list[str], value: str, reference: str, up: float = 1.10, down: float = 0.85
) -> DataFrame:
    """Adds state: work at ``up`` of the reference, recovery at ``down``, in between as before (first: recovery)."""
    crossed = F.when(F.col(value) >= up * F.col(reference), "work").when(F.col(value) <= down * F.col(reference), "recovery")
    state = F.last(F.col("crossed"), ignorenulls=True).over(over(keys, order))
    return df.withColumn("crossed", crossed).withColumn("state", F.coalesce(state, F.lit("recovery"))).drop("crossed")


def zone_time(df: DataFrame, keys: list[str], order: list[str], value: str, bounds: list[float], cap_s: float = 30) -> DataFrame:
    """Per series and zone: microseconds of capped steps; zones without any are 0. A zone counts the bounds below a value."""
    zone = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: F.col(value) > b))
    steps = pairwise_dt(df, keys, order).where(F.col("dt") > 0).where(F.col(value).isNotNull()).withColumn("zone", zone)
    sums = steps.groupBy(*keys, "zone").agg(F.sum(F.least("dt", F.lit(int(cap_s * MICROS)))).alias("us"))
    spine = df.select(*keys).distinct().withColumn("zone", F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))))
    return spine.join(sums, [*keys, "zone"], "left").select(*keys, "zone", F.coalesce("us", F.lit(0)).cast("long").alias("us"))


def mean_max(df: DataFrame, keys: list[str], order: list[str], value: str, windows: list[int], present: float = 0.9) -> DataFrame:
    """Per series: the best mean over each number of rows, of windows with enough values. One sort serves all windows."""
    w = over(keys, order)
    out = df.withColumn("rn", F.row_number().over(w))
    for n in windows:
        rows = w.rowsBetween(-(n - 1), 0)
        enough = (F.col("rn") >= n) & (F.count(value).over(rows) >= int(present * n + 0.999999))
        out = out.withColumn(f"m{n}", F.when(enough, F.avg(value).over(rows)))
    return out.groupBy(*keys).agg(*(F.max(f"m{n}").alias(f"best_{n}") for n in windows))


def weighted_mean(df: DataFrame, keys: list[str], order: list[str], value: str, width: int = 30, power: float = 4) -> DataFrame:
    """Per series: the power mean of rolling means over present values; null with fewer than ``width`` of them."""
    w = over(keys, order)
    rolling = (
        df.where(F.col(value).isNotNull())
        .withColumn("rn", F.row_number().over(w))
        .withColumn("m", F.avg(value).over(w.rowsBetween(-(width - 1), 0)))
    )
    means = rolling.groupBy(*keys).agg(
        F.pow(F.avg(F.when(F.col("rn") >= width, F.pow("m", F.lit(power)))), F.lit(1 / power)).alias("weighted")
    )
    return means


def halves(df: DataFrame, keys: list[str], order: list[str], value: str, least: int = 60) -> DataFrame:
    """Per series: means of the first and second half of its present values, if each has ``least``."""
    present = (
        df.where(F.col(value).isNotNull())
        .withColumn("rn", F.row_number().over(over(keys, order)))
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        .withColumn("first", F.col("rn") <= F.floor(F.col("n") / 2))
    )
    return (
        present.groupBy(*keys)
        .agg(
            F.avg(F.when(F.col("first"), F.col(value))).alias("first_half"),
            F.avg(F.when(~F.col("first"), F.col(value))).alias("second_half"),
            F.count_if("first").alias("n_first"),
        )
        .where(F.col("n_first") >= least)
        .drop("n_first")
    )


def drift(df: DataFrame, keys: list[str], order: list[str], effort: str, heart: str, least: int = 60) -> DataFrame:
    """Per series: the fall in percent of effort over heart rate from the first half to the second."""
    pairs = (
        df.where(F.col(effort).isNotNull() & (F.col(heart) > 0))
        .withColumn("rn", F.row_number().over(over(keys, order)))
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        .withColumn("first", F.col("rn") <= F.floor(F.col("n") / 2))
    )
    ratio = lambda side: F.sum(F.when(side, F.col(effort))) / F.sum(F.when(side, F.col(heart)))
    halved = pairs.groupBy(*keys).agg(
        ratio(F.col("first")).alias("a"), ratio(~F.col("first")).alias("b"), F.count_if("first").alias("n_first")
    )
    return halved.where((F.col("n_first") >= least) & (F.col("a") > 0)).select(*keys, ((1 - F.col("b") / F.col("a")) * 100).alias("drift_pct"))


def sessions_by_rest(df: DataFrame, keys: list[str], order: list[str], rest_us: int) -> DataFrame:
    """Adds set_no: a new set begins after a rest of ``rest_us`` or an unknown one."""
    w = over(keys, order)
    rest = F.col("t") - F.lag("t").over(w)
    new = F.coalesce(rest >= rest_us, F.lit(True)).cast("int")
    return df.withColumn("new", new).withColumn("set_no", F.sum("new").over(w)).drop("new")


def timer_intervals(df: DataFrame, keys: list[str], order: list[str], start: Column, stop: Column) -> DataFrame:
    """(keys, a, b) while a timer runs. A start while it runs and a stop while it rests change nothing; a first
    stop ends an interval from the first record, and an open interval ends at the last."""
    w = over(keys, order)
    ends = df.groupBy(*keys).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    control = df.withColumn("kind", F.when(start, "start").when(stop, "stop")).where("kind IS NOT NULL")
    control = control.withColumn("before", F.lag("kind").over(w)).where("before IS NULL OR before <> kind")
    control = control.withColumn("next_t", F.lead("t").over(w)).join(ends, keys)
    starts = control.where("kind = 'start'").select(*keys, F.col("t").alias("a"), F.coalesce("next_t", "last_t").alias("b"))
    opened = control.where("kind = 'stop' AND before IS NULL").select(*keys, F.col("first_t").alias("a"), F.col("t").alias("b"))
    bare = ends.join(control.select(*keys).distinct(), keys, "left_anti").select(*keys, F.col("first_t").alias("a"), F.col("last_t").alias("b"))
    return starts.unionByName(opened).unionByName(bare)


def ascent(df: DataFrame, keys: list[str], order: list[str], value: str, threshold: float = 3.0) -> DataFrame:
    """Per series: climb and fall with hysteresis, folded over the ordered values of one series."""
    held = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("v")))).alias("held"))
    )
    zero = F.struct(F.col("held")[0]["v"].alias("ref"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))

    def step(acc: Column, x: Column) -> Column:
        d = x["v"] - acc["ref"]
        return F.struct(
            F.when(F.abs(d) >= threshold, x["v"]).otherwise(acc["ref"]).alias("ref"),
            (acc["up"] + F.when(d >= threshold, d).otherwise(0.0)).alias("up"),
            (acc["down"] + F.when(d <= -threshold, -d).otherwise(0.0)).alias("down"),
        )

    folded = held.withColumn("out", F.aggregate("held", zero, step))
    return folded.select(*keys, F.col("out.up").alias("ascent"), F.col("out.down").alias("descent"))


def splits(df: DataFrame, keys: list[str], order: list[str], distance: str, length: float) -> DataFrame:
    """Crossings of each multiple of ``length``: keys, split, t (microseconds, interpolated), duration_us."""
    w = over(keys, order)
    steps = (
        df.where(F.col(distance).isNotNull())
        .withColumn("d0", F.lag(distance).over(w))
        .withColumn("t0", F.lag("t").over(w))
        .withColumn("origin", F.first(distance).over(w))
        .withColumn("start_t", F.first("t").over(w))
        .where(F.col(distance) > F.col("d0"))
    )
    k0 = F.floor((F.col("d0") - F.col("origin")) / length) + 1
    k1 = F.floor((F.col(distance) - F.col("origin")) / length)
    crossed = steps.where(k1 >= k0).withColumn("split", F.explode(F.sequence(k0, k1)))
    share = (F.col("origin") + F.col("split") * length - F.col("d0")) / (F.col(distance) - F.col("d0"))
    crossed = crossed.withColumn("at", F.col("t0") + F.round(share * (F.col("t") - F.col("t0"))).cast("long"))
    before = F.lag("at").over(Window.partitionBy(*keys).orderBy("split"))
    return crossed.select(*keys, "split", F.col("at").alias("t"), (F.col("at") - F.coalesce(before, "start_t")).alias("duration_us"))


def spikes(df: DataFrame, keys: list[str], order: list[str], value: str, ceiling: float) -> DataFrame:
    """Adds spike: a point reached and left faster than ``ceiling`` a second, while its neighbours fit each other."""
    w = over(keys, order)
    present = df.where(F.col(value).isNotNull())
    a, b = F.lag(value).over(w), F.lead(value).over(w)
    ta, tb = F.lag("t").over(w), F.lead("t").over(w)
    present = present.withColumns({"a": a, "b": b, "ta": ta, "tb": tb})
    speed = lambda x, y, t: F.abs(x - y) * MICROS / F.when(t > 0, t)
    v, t = F.col(value), F.col("t")
    spike = (
        (speed(v, F.col("a"), t - F.col("ta")) > ceiling)
        & (speed(F.col("b"), v, F.col("tb") - t) > ceiling)
        & (speed(F.col("b"), F.col("a"), F.col("tb") - F.col("ta")) <= ceiling)
    )
    return present.withColumn("spike", F.coalesce(spike, F.lit(False))).drop("a", "b", "ta", "tb")


def unwrap(df: DataFrame, keys: list[str], order: list[str], value: str, modulus: int) -> DataFrame:
    """Adds total: a counter that begins anew at ``modulus``, made to grow on."""
    w = over(keys, order)
    back = F.coalesce((F.col(value) < F.lag(value).over(w)).cast("long"), F.lit(0))
    return df.withColumn("back", back).withColumn("total", F.sum("back").over(w) * modulus + F.col(value)).drop("back")


def fitness(loads: DataFrame, keys: list[str], day: str, load: str, slow: float = 42, fast: float = 7) -> DataFrame:
    """Per day from the first to the last: exponentially weighted loads, and yesterday's difference as form.

    Days without a load count as 0. The days of a series are folded as one array.
    """
    daily = loads.groupBy(*keys, day).agg(F.sum(load).alias("load"))
    spine = daily.groupBy(*keys).agg(F.min(day).alias("a"), F.max(day).alias("b")).select(
        *keys, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias(day)
    )
    filled = spine.join(daily, [*keys, day], "left").withColumn("load", F.coalesce("load", F.lit(0.0)))
    held = filled.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(day, "load"))).alias("days"))

    def level(tau: float) -> Column:
        import math

        k = 1 - math.exp(-1 / tau)
        zero = F.array().cast("array<double>")
        return F.aggregate(
            "days",
            zero,
            lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) * (1 - k) + x["load"] * k)),
        )

    out = held.withColumn("slow", level(slow)).withColumn("fast", level(fast))
    rows = out.select(*keys, F.posexplode("days").alias("i", "d"), "slow", "fast")
    before = lambda c: F.coalesce(F.get(c, F.col("i") - 1), F.lit(0.0))
    return rows.select(
        *keys, F.col(f"d.{day}").alias(day), F.col("d.load").alias("load"),
        F.get("slow", F.col("i")).alias("fitness"), F.get("fast", F.col("i")).alias("fatigue"),
        (before("slow") - before("fast")).alias("form"),
    )
