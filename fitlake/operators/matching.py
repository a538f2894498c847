"""Joins of records with intervals, of declared with derived totals, and of findings with remedies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign_sessions(records: DataFrame, sessions: DataFrame, keys: list[str], record_id: str) -> DataFrame:
    """Each record with the session that owns it: the first by number that holds its time (both ends count).

    Records of no session go to the one that starts nearest, ties to the lowest number; ``inside`` tells the
    two apart. ``sessions`` has the keys, session, a and b, and numbers ascend with a. Records and the ends of
    sessions are sorted by time together, so a record never meets all sessions of its series: the first session
    that holds a time is the first whose end isn't before it, among those that end later than all before them.
    """
    by_number = Window.partitionBy(*keys).orderBy("session")
    ends = sessions.withColumn("before", F.max("b").over(by_number.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.where("b IS NOT NULL AND (before IS NULL OR b > before)")
    starts = sessions.groupBy(*keys, "a").agg(F.min("session").alias("session"))
    no_record = F.lit(None).cast(records.schema[record_id].dataType).alias(record_id)
    none = F.lit(None).cast(starts.schema["session"].dataType).alias("session")
    line = (
        records.select(*keys, record_id, F.col("t").cast("long"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("a"), none)
        .unionAll(starts.select(*keys, no_record, F.col("a").cast("long").alias("t"), F.lit(0), F.col("a").cast("long"), "session"))
        .unionAll(ends.select(*keys, no_record, F.col("b").cast("long").alias("t"), F.lit(2), F.col("a").cast("long"), "session"))
    )
    mark = lambda side: F.when(F.col("side") == side, F.struct("session", "a"))
    back = Window.partitionBy(*keys).orderBy("t", "side")
    ahead = Window.partitionBy(*keys).orderBy(F.col("t").desc(), F.col("side").desc())
    line = line.select(
        *keys, record_id, "t", "side", F.last(mark(0), ignorenulls=True).over(back).alias("last_start"),
        F.last(mark(0), ignorenulls=True).over(ahead).alias("next_start"), F.last(mark(2), ignorenulls=True).over(ahead).alias("holder"),
    ).where("side = 1 AND (last_start IS NOT NULL OR next_start IS NOT NULL)")
    inside = F.coalesce(F.col("holder.a") <= F.col("t"), F.lit(False))
    nearer = F.col("next_start").isNull() | (F.col("t") - F.col("last_start.a") <= F.col("next_start.a") - F.col("t"))
    nearest = F.when(F.col("last_start").isNotNull() & nearer, F.col("last_start.session")).otherwise(F.col("next_start.session"))
    return line.select(*keys, record_id, F.when(inside, F.col("holder.session")).otherwise(nearest).alias("session"), inside.alias("inside"))


def inside_any(records: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """The records whose time lies in any interval (a to b, both included) of their series.

    Records and starts are sorted by time together: a time is inside if the latest end so far isn't before it.
    """
    starts = intervals.select(*keys, F.col("a").alias("t"), F.lit(0).alias("side"), F.col("b").alias("end"))
    line = records.withColumn("side", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    latest = F.max("end").over(Window.partitionBy(*keys).orderBy("t", "side"))
    return line.withColumn("end", latest).where("side = 1 AND end >= t").select(*records.columns)


def reconcile(declared: DataFrame, derived: DataFrame, keys: list[str], fields: dict[str, tuple[float, float]]) -> DataFrame:
    """(keys, field, declared, derived, delta) where both are known and differ by more than
    max(floor, relative * |declared|); ``fields`` gives (floor, relative) by field. Nothing is corrected."""
    unpivot = lambda df, name: df.unpivot(keys, [F.col(f) for f in fields], "field", name)
    floor = F.create_map(*[F.lit(x) for f, (a, _) in fields.items() for x in (f, float(a))])
    relative = F.create_map(*[F.lit(x) for f, (_, b) in fields.items() for x in (f, float(b))])
    both = unpivot(declared, "declared").join(unpivot(derived, "derived"), [*keys, "field"])
    delta = F.col("derived") - F.col("declared")
    limit = F.greatest(floor[F.col("field")], relative[F.col("field")] * F.abs("declared"))
    return both.where(F.abs(delta) > limit).withColumn("delta", delta)


def remedies(findings: DataFrame, table: DataFrame) -> DataFrame:
    """Findings with their remedies (code, priority, command); a finding without one has null.

    Where several codes of a file share a command, it is listed for each. Order by priority and command to
    get them as they should be tried.
    """
    return findings.join(table, "code", "left")


def unresolved(findings: DataFrame, table: DataFrame) -> DataFrame:
    """The findings that no remedy covers."""
    return findings.join(table.select("code"), "code", "left_anti")
