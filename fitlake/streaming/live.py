"""Files and samples that arrive continuously.

New files go through the same parser as in batches. Samples of a series keep the sample before them
as state, so steps cross micro-batches; a sample older than its series has got is marked late, never
dropped. Samples at the same time keep the order of ``sequence``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import fit

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_messages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Messages of the files that come into a folder, with the columns of ``read_messages``."""
    files = (
        spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    )
    return fit.messages_of(files.select(F.sha2("content", 256).alias("file_id"), "content"))


def stream_steps(samples: DataFrame, keys: list[str], t: str = "t", value: str = "value", sequence: str = "seq") -> DataFrame:
    """(keys as text, t, value, dt, late): microseconds since the sample before, null for the first and for late ones.

    State is one time for each series.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        held = pd.concat(list(batches)).sort_values(["t", "seq"], kind="stable")
        late = held["t"] < last if last is not None else pd.Series(False, index=held.index)
        timely = held["t"].where(~late)
        before = timely.ffill().shift()
        if last is not None:
            before = before.fillna(last)
        out = pd.DataFrame({f"k{i}": [k] * len(held) for i, k in enumerate(key)}, index=held.index)
        out = out.assign(t=held["t"], value=held["value"], dt=(timely - before).astype("Int64"), late=late)
        newest = held["t"].max()
        state.update((int(newest if last is None else max(last, newest)),))
        yield out

    named = [F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]
    given = samples.where(F.col(t).isNotNull()).select(*named, F.col(t).cast("long").alias("t"), F.col(value).cast("double").alias("value"), F.col(sequence).cast("long").alias("seq"))
    columns = [f"k{i}" for i in range(len(keys))]
    schema = ", ".join(f"{c} string" for c in columns) + ", t long, value double, dt long, late boolean"
    steps = given.groupBy(*columns).applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.NoTimeout)
    return steps.select(*(F.col(c).alias(k) for c, k in zip(columns, keys, strict=True)), "t", "value", "dt", "late")


def stream_zone_time(steps: DataFrame, keys: list[str], bounds: list[float], window: str = "1 hour", watermark: str = "10 minutes", cap_s: float = 30) -> DataFrame:
    """Per series, window and zone: microseconds of capped steps. Each step counts for the value it ends with."""
    zone = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: F.col("value") > b))
    timed = steps.where("dt > 0 AND value IS NOT NULL").withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", watermark)
    spent = F.sum(F.least("dt", F.lit(int(cap_s * 1_000_000))))
    return timed.groupBy(*keys, F.window("ts", window), zone.alias("zone")).agg(spent.alias("us"))


def stream_sessions(samples: DataFrame, keys: list[str], ts: str = "ts", rest: str = "10 seconds", watermark: str = "1 minute") -> DataFrame:
    """Per series: stretches without a rest as long as ``rest``: start, end of the last sample, number of samples."""
    held: Column = F.session_window(ts, rest)
    grouped = samples.withWatermark(ts, watermark).groupBy(*keys, held)
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_ts"))
    return out.select(*keys, F.col("session_window.start").alias("first_ts"), "last_ts", "n")


def _stateful(samples: DataFrame, keys: list[str], columns: dict[str, Column], body, output: str, state: str) -> DataFrame:
    """``body`` of (rows of a series in order, its state or None) -> (rows of the result, new state), for each micro-batch."""
    named = [F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]
    given = samples.select(*named, *(c.alias(name) for name, c in columns.items())).where("t IS NOT NULL")

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["t", "seq"], kind="stable")
        out, after = body(rows, held.get if held.exists else None)
        held.update(after)
        if len(out):
            yield pd.DataFrame({f"k{i}": [k] * len(out) for i, k in enumerate(key)}).join(out.reset_index(drop=True))

    names = [f"k{i}" for i in range(len(keys))]
    schema = ", ".join(f"{c} string" for c in names) + ", " + output
    found = given.groupBy(*names).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)
    return found.withColumnsRenamed(dict(zip(names, keys, strict=True)))


def stream_timer(events: DataFrame, keys: list[str], t: str = "t", kind: str = "kind", sequence: str = "seq") -> DataFrame:
    """(keys as text, a, b): stretches for which a timer ran, each when its stop has come.

    ``kind`` is start or stop, all else is passed over. A start while the timer runs and a stop while it rests
    change nothing. State is the time of the last start.
    """

    def body(rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        began, out = held[0] if held else None, []
        for at, what in zip(rows["t"], rows["kind"], strict=True):
            if what == "start" and began is None:
                began = int(at)
            elif what == "stop" and began is not None:
                out.append((began, int(at)))
                began = None
        return pd.DataFrame(out, columns=["a", "b"]), (began,)

    columns = {"t": F.col(t).cast("long"), "kind": F.col(kind).cast("string"), "seq": F.col(sequence).cast("long")}
    return _stateful(events, keys, columns, body, "a long, b long", "began long")


def stream_effort(
    steps: DataFrame, keys: list[str], window: str = "1 hour", watermark: str = "10 minutes", cap_s: float = 30,
    max_hr: float | None = None, rest_hr: float | None = None,
) -> DataFrame:
    """Per series and window: work of capped steps (value is power, in joules), and training impulse (value is heart rate).

    ``steps`` is that of ``stream_steps``; impulse is null without thresholds.
    """
    seconds = F.least("dt", F.lit(int(cap_s * 1_000_000))) / 1_000_000
    impulse = F.lit(None).cast("double")
    if max_hr is not None and rest_hr is not None and max_hr > rest_hr:
        reserve = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - rest_hr) / (max_hr - rest_hr)))
        impulse = seconds / 60 * reserve * 0.64 * F.exp(1.92 * reserve)
    timed = steps.where("dt > 0 AND value IS NOT NULL").withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", watermark)
    return timed.groupBy(*keys, F.window("ts", window)).agg(F.sum(F.col("value") * seconds).alias("work_j"), F.sum(impulse).alias("trimp"))


def stream_mean_max(samples: DataFrame, keys: list[str], windows: list[int], t: str = "t", value: str = "value", sequence: str = "seq", power: float = 4) -> DataFrame:
    """(keys as text, n, best, weighted) after each micro-batch: the best mean over n samples so far, and their power mean.

    Samples come in order within a micro-batch; State is as many samples as the longest window, and sums.
    """
    longest = max(windows)

    def body(rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        tail, best, sums, counts = (list(x) for x in held) if held else ([], [float("-inf")] * len(windows), [0.0] * len(windows), [0] * len(windows))
        fresh = rows["value"].dropna().tolist()
        joined = pd.Series([*tail, *fresh], dtype=float)
        for k, n in enumerate(windows):
            means = joined.rolling(n).mean().iloc[len(tail) :].dropna()
            best[k] = max([best[k], *means.tolist()])
            sums[k] += float((means**power).sum())
            counts[k] += len(means)
        out = [(n, best[k], (sums[k] / counts[k]) ** (1 / power)) for k, n in enumerate(windows) if counts[k]]
        kept = joined.tail(longest - 1).tolist() if longest > 1 else []
        return pd.DataFrame(out, columns=["n", "best", "weighted"]), (kept, best, sums, counts)

    columns = {"t": F.col(t).cast("long"), "value": F.col(value).cast("double"), "seq": F.col(sequence).cast("long")}
    return _stateful(samples, keys, columns, body, "n int, best double, weighted double", "tail array<double>, best array<double>, sums array<double>, counts array<long>")
