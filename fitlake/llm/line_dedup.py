"""Line dedup: drop lines that occur in many documents.

Lines are exploded, normalised and hashed; distinct documents are counted for each hash; lines
over the threshold go, and the rest of each text is put together again by position. Everything
runs as DataFrame expressions in the JVM.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize

#: White space that counts at the ends of a line: \x20 and \x09 to \x0D.
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line without white space at both ends, with A-Z in lower case and all else as it is."""
    bare = F.trim(line, F.lit(SPACE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    )


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """(row, n_lines, n_dropped, kept_text) for each row of ``docs``; ``row`` holds all its columns.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` distinct ids loses
    all its lines but those in the largest id that holds it. Null or empty text is one empty line.
    A row whose id is null is not counted and keeps all its lines. Rows that repeat an id count as
    one document; each gives a row of the result. Extra columns of any name stay inside ``row``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text.alias("t"))
    rows_of = [F.col("id"), F.xxhash64("t").alias("version")]

    lines = (
        base.where("id IS NOT NULL")
        .select(*rows_of, F.posexplode(F.split("t", "\n")).alias("pos", "line"))
        .where(F.char_length("line") >= min_chars)
        .select("id", "version", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        # Two hashes with different seeds: 128 bits, so that equal hashes mean equal keys.
        .select("id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(97), "key").alias("h2"))
    )
    lines = materialize(lines, "lines")
    frequent = (
        lines.select("h1", "h2", "id")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"))
        .where(F.col("n") >= min_docs)
    )
    dropped = (
        lines.join(frequent, ["h1", "h2"])
        .where("id <> last_id")
        .select("id", "version", "pos")
        .distinct()
        .groupBy("id", "version")
        .agg(F.collect_list("pos").alias("gone"))
    )
    kept = F.transform(  # the one-element array evaluates the split once
        F.array(F.split("t", "\n")),
        lambda all_lines: F.concat_ws(
            "\n",
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone")),
                lambda i: F.get(all_lines, i),
            ),
        ),
    )[0]
    joined = base.withColumn("version", F.xxhash64("t")).join(dropped, ["id", "version"], "left")
    newlines = F.char_length("t") - F.char_length(F.replace(F.col("t"), F.lit("\n"), F.lit("")))
    return joined.select(
        "row",
        (newlines + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("t")).otherwise(kept).alias("kept_text"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_lines, n_dropped and the SHA-256 of the text that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_repeated_lines(docs).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        "n_dropped",
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with repeated lines taken out of their texts; n_chars follows."""
    out = drop_repeated_lines(docs)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept_text"))
    columns = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return out.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def oracle_lines(source: str = "documents") -> str:
    """DuckDB: one row per line of ``source`` with its key and whether it goes."""
    return f"""
    SELECT doc_id, text, pos, line, key,
           length(key) >= 40 AND n_docs >= 5 AND doc_id <> last_id AS gone
    FROM (
      SELECT *, count(DISTINCT doc_id) OVER (PARTITION BY key) AS n_docs,
             max(doc_id) OVER (PARTITION BY key) AS last_id
      FROM (
        SELECT doc_id, text, pos, line,
               translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (
          SELECT doc_id, text, unnest(lines) AS line, unnest(range(len(lines))) AS pos
          FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM {source})
        )
      )
    )"""


ORACLE = {
    "op7_line_dedup": f"""
    SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM ({oracle_lines()}) GROUP BY doc_id"""
}
