"""One document per file: parts, sessions with their laps, gaps and streams, and all other messages.

Everything is nested by keys of the file, so a document is as large as its file and no larger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import activity
from .activity import OWN, PART
from .keep import keep

SCHEMA_VERSION = 1


def part_types(messages: DataFrame) -> DataFrame:
    """(keys of a part, file_type): what its first file_id says; unknown, or unknown_<n>, where nothing names it."""
    said = F.when(F.col("global_num") == 0, F.get_json_object("fields", "$.type"))  # other messages aren't parsed
    first = F.min_by(F.coalesce(said, F.lit("")), F.when(F.col("global_num") == 0, F.col("msg_seq")))
    named = messages.groupBy(*PART).agg(first.alias("said"))
    kind = F.when(F.coalesce("said", F.lit("")) == "", "unknown").when(F.col("said").rlike("^[0-9]+$"), F.concat(F.lit("unknown_"), "said")).otherwise(F.col("said"))
    return named.select(*PART, kind.alias("file_type"))


def primary_parts(types: DataFrame) -> DataFrame:
    """(file_id, part): the part that stands for a file: the first activity, else the first."""
    best = F.min(F.struct((F.col("file_type") != "activity").cast("int").alias("other"), "part"))
    return types.groupBy("file_id").agg(best.alias("best")).select("file_id", F.col("best.part").alias("part"))


def of_activities(messages: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """The messages of the parts that are activities: only these have sessions. ``types`` spares finding them anew."""
    return messages.join((part_types(messages) if types is None else types).where("file_type = 'activity'").select(*PART), PART, "left_semi")


def known_only(messages: DataFrame) -> DataFrame:
    """Without messages that the profile doesn't name."""
    return messages.where(~F.col("name").startswith("unknown_"))


def without_pii(messages: DataFrame) -> DataFrame:
    """Without profiles of athletes; serial numbers are null."""
    fields = F.regexp_replace("fields", r'"serial_number": ?[^,}]+', '"serial_number": null')
    return messages.where("name <> 'user_profile'").withColumn("fields", fields)


def session_streams(messages: DataFrame, owned: DataFrame) -> DataFrame:
    """(keys, times, streams): seconds of a session's records, and each stream by name with a value or null for each of them."""
    said = activity.row_streams(messages).dropDuplicates([*PART, "i"])
    rows = owned.select(*OWN, "t", "i").join(said, [*PART, "i"], "left")
    axis = rows.groupBy(*OWN).agg(F.sort_array(F.collect_list(F.struct("t", "i", "said"))).alias("axis"))
    # Each row has its own small map: a map of all rows would be searched from its start for each of them.
    maps = F.transform("axis", lambda x: F.map_from_entries(x["said"]))
    names = F.sort_array(F.array_distinct(F.flatten(F.transform("axis", lambda x: F.coalesce(x["said"]["stream"], F.array().cast("array<string>"))))))
    values = lambda name: F.transform("by_row", lambda row: F.element_at(row, name))
    streams = F.transform("names", lambda name: F.struct(name.alias("stream"), values(name).alias("values")))
    times = F.transform("axis", lambda x: (x["t"] / 1_000_000).cast("long"))
    lined = axis.withColumns({"names": names, "by_row": maps})
    return lined.select(*OWN, times.alias("times"), F.when(F.size("names") > 0, streams).alias("streams"))


def documents(messages: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file_id, document): JSON with the version of the schema, parts, sessions, gaps, and messages that aren't records.

    Only activities have sessions, and only where there is one are their records left to the streams. ``files``
    (``read_files``) adds error and provenance. Write ``messages`` as a table before, so that files are parsed once.
    """
    types = keep(part_types(messages), "types")
    acts = of_activities(messages, types)
    held, owned = activity.kept(acts)
    listed = lambda df, name, *order: df.groupBy(*OWN).agg(
        F.sort_array(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in (*OWN, *order)]))).alias(name)
    )
    laps = listed(activity.laps(acts, held).drop("i"), "laps", "t")
    gaps = listed(activity.gaps(owned, acts, files, held), "gaps", "t")
    wrong = listed(activity.discrepancies(held, activity.derived_totals(owned, acts, held)), "discrepancies", "field")
    nested = held
    for more in (laps, gaps, wrong, session_streams(acts, owned)):
        nested = nested.join(more, OWN, "left")
    entry = F.struct("session", *[c for c in nested.columns if c not in OWN])
    sessions = nested.groupBy(*PART).agg(F.sort_array(F.collect_list(F.struct("session", F.to_json(entry).alias("json")))).alias("s"))
    modelled = F.col("file_type") == "activity"
    others = messages.join(types, PART).where(~modelled | (F.col("global_num") != 20))
    others = others.groupBy(*PART).agg(F.sort_array(F.collect_list(F.struct("msg_seq", "name", "fields"))).alias("m"))
    raw = lambda items, text: F.concat(F.lit("["), F.array_join(F.transform(items, text), ","), F.lit("]"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    parts = types.join(sessions, PART, "left").join(others, PART, "left").select(
        "file_id", "part",
        F.concat(
            F.lit('{"file_type":'), quoted(F.col("file_type")),
            F.lit(',"sessions":'), raw(F.coalesce("s", F.array()), lambda x: x["json"]),
            F.lit(',"messages":'), raw(F.coalesce("m", F.array()), lambda x: F.concat(F.lit('{"name":'), quoted(x["name"]), F.lit(',"fields":'), x["fields"], F.lit("}"))),
            F.lit("}"),
        ).alias("json"),
    )
    whole = parts.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("part", "json"))).alias("p"))
    whole = whole.join(primary_parts(types).withColumnRenamed("part", "first"), "file_id")
    tail = F.lit("")
    if files is not None:
        whole = whole.join(files.select("file_id", "error", "provenance"), "file_id", "left")
        tail = F.concat(F.lit(',"error":'), F.coalesce(quoted(F.col("error")), F.lit("null")), F.lit(',"provenance":'), F.coalesce(F.to_json("provenance"), F.lit("[]")))
    text = F.concat(F.lit(f'{{"schema":{SCHEMA_VERSION},"primary":'), F.col("first").cast("string"), F.lit(',"parts":'), raw(F.col("p"), lambda x: x["json"]), tail, F.lit("}"))
    return whole.select("file_id", text.alias("document"))
