"""Quality rules with verdicts on hosts.

Rules on each document give a failure or none. Failures are aggregated by host (the domain that a
document comes from), the failure rates are shrunk with a beta prior that is fitted to all hosts,
and the verdict on a host is joined back to its documents. All of it runs as DataFrame
expressions in the JVM: the counts of a document come from arrays inside its row, so texts are
never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize

#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight, counted in documents.
PRIOR_WEIGHT = (1.0, 10_000.0)
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """``body`` of a variable that holds ``value``, evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in ``words``.

    The hash of each window is sorted with its position, so that equal windows become neighbours.
    Linear memory, n log n time.
    """

    def marked(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return _let(F.sort_array(pairs), positions)

    def positions(order: Column) -> Column:
        def twice(x: Column, j: Column) -> Column:
            same = lambda k: F.coalesce(F.get(order, k)["h"] == x["h"], F.lit(False))
            return same(j - 1) | same(j + 1)

        found = F.sort_array(F.transform(F.filter(order, twice), lambda x: x["i"]))
        return _let(
            found,
            lambda p: F.aggregate(
                F.transform(
                    p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))
                ),
                F.lit(0).cast("long"),
                lambda total, covered: total + covered,
            ),
        )

    hashed = _let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda hs: F.transform(
            F.sequence(F.lit(0), F.size(hs) - window),
            lambda i: F.xxhash64(*[F.get(hs, i + d) for d in range(window)]),
        ),
    )
    return F.when(F.size(words) > window, _let(hashed, marked)).otherwise(F.lit(0).cast("long"))


def document_counts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(row, id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).alias("id"),
        F.lower(F.trim(F.col(host_col).cast("string"))).alias("host"),
        text.alias("t"),
    )
    words = F.filter(F.split("t", SPACE_PATTERN), lambda w: w != "")
    dup_lines = _let(
        F.filter(F.split("t", "\n"), lambda line: F.trim(line, F.lit(SPACE)) != ""),
        lambda lines: F.size(lines) - F.size(F.array_distinct(lines)),
    )
    counted = base.select(
        "row",
        "id",
        "host",
        _let(words, lambda ws: F.struct(F.size(ws).alias("n"), repeated_words(ws).alias("repeat"))).alias("w"),
        F.char_length(F.translate("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"),
    )
    n, repeat = F.col("w.n").cast("long"), F.col("w.repeat").cast("long")
    return counted.select(
        "row",
        "id",
        "host",
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeat.alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_verdicts(counts: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n_docs, n_failed, rate, shrunk_rate, host_rejected) of every host.

    The prior is beta(mean * weight, (1 - mean) * weight), where the mean is that of all documents
    that have a host, and the weight comes from how much the rates of hosts vary beyond what chance
    gives to hosts of their sizes (method of moments), within PRIOR_WEIGHT.
    """
    hosts = (
        counts.where("host IS NOT NULL")
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
        .withColumn("rate", F.col("n_failed") / F.col("n_docs"))
    )
    total = hosts.agg(
        F.sum("n_docs").alias("all_docs"),
        F.sum("n_failed").alias("all_failed"),
        F.count(F.lit(1)).alias("n_hosts"),
        F.sum(F.col("n_failed") * F.col("rate")).alias("squares"),
    )
    mean = F.col("all_failed") / F.col("all_docs")
    prior = total.select(mean.alias("mean"), (mean * (1 - mean)).alias("spread"), "all_docs", "n_hosts", "squares").select(
        "mean",
        "spread",
        # The weighted variance of the rates, less what chance gives.
        F.greatest(
            F.lit(0.0),
            F.col("squares") / F.col("all_docs")
            - F.col("mean") * F.col("mean")
            - F.col("spread") * F.col("n_hosts") / F.col("all_docs"),
        ).alias("between"),
    )
    low, high = map(F.lit, PRIOR_WEIGHT)
    weight = F.when(F.col("between") > 0, F.least(high, F.greatest(low, F.col("spread") / F.col("between") - 1)))
    prior = prior.select("mean", F.coalesce(weight, high).alias("weight"))
    # One row: the totals over all hosts.
    return (
        hosts.join(F.broadcast(prior))
        .withColumn(
            "shrunk_rate", (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
        )
        .select("host", "n_docs", "n_failed", "rate", "shrunk_rate", (F.col("shrunk_rate") > max_rate).alias("host_rejected"))
    )


def rejected_hosts(counts: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host) of the rejected hosts, as a written table: Spark knows its size, and broadcasts it if it is small.

    Otherwise a join would deal the documents by host, and a host with a third of them to one task.
    """
    return materialize(host_verdicts(counts, max_rate).where("host_rejected").select("host"), "rejected-hosts")


def quality_verdicts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_rate: float = MAX_HOST_RATE,
) -> DataFrame:
    """(id, the counts of a document, base_failed, kept), one row for each row of ``docs``.

    A document is kept unless its own rules fail or its host is rejected. Null text counts as
    empty and so fails. A null host has no verdict. Rows that repeat an id are judged one by one.
    Extra columns don't matter, whatever their names. An empty table gives an empty result.
    """
    counts = materialize(document_counts(docs, id_col, text_col, host_col).drop("row"), "rules")
    rejected = rejected_hosts(counts, max_rate).withColumn("host_rejected", F.lit(True))
    return (
        counts.join(rejected, "host", "left")
        .withColumn("kept", ~F.col("base_failed") & F.col("host_rejected").isNull())
        .drop("host", "host_rejected")
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its counts, base_failed, and kept with the verdict on its source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_verdicts(docs).withColumnRenamed("id", "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose own rules and whose host pass.

    Rules are evaluated once: each document's verdict is written beside it, without the row where the rules
    fail. The hosts' totals read two small columns of that table; texts are never shuffled.
    """
    counts = document_counts(docs, "doc_id", "text", "source")
    judged = counts.select("host", "base_failed", F.when(~F.col("base_failed"), F.col("row")).alias("row"))
    judged = materialize(judged, "rules")
    rejected = rejected_hosts(judged.select("host", "base_failed"))
    return judged.where(~F.col("base_failed")).join(rejected, "host", "left_anti").select("row.*")


def oracle_rules(source: str = "documents", max_rate: float = MAX_HOST_RATE) -> str:
    """DuckDB: the rows of ``source`` with their counts, base_failed and kept."""
    return f"""
    WITH words AS (
      SELECT *, row_number() OVER () AS rid,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws,
             list_filter(string_split(coalesce(text, ''), chr(10)),
                         lambda s: NOT regexp_full_match(s, '[\\x20\\x09-\\x0D]*')) AS ls
      FROM {source}
    ), windows AS (
      SELECT rid, i, ws[i:i + 2] AS win
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM words)
    ), covered AS (
      SELECT rid, count(DISTINCT j) AS n_repeat_words
      FROM (
        SELECT rid, unnest([i, i + 1, i + 2]) AS j
        FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n >= 2
      ) GROUP BY rid
    ), counts AS (
      SELECT w.* EXCLUDE (ws, ls), len(ws)::BIGINT AS n_words,
             length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM words w LEFT JOIN covered c USING (rid)
    ), judged AS (
      SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, lower(trim(source)) AS host FROM counts
    ), hosts AS (
      SELECT host, count(*)::DOUBLE AS n, (count(*) FILTER (base_failed))::DOUBLE AS f
      FROM judged WHERE host IS NOT NULL GROUP BY host
    ), prior AS (
      SELECT m, s, greatest(0.0, q / n - m * m - s * h / n) AS b
      FROM (SELECT sum(f) / sum(n) AS m, sum(f) / sum(n) * (1 - sum(f) / sum(n)) AS s,
                   sum(n) AS n, count(*) AS h, sum(f * f / n) AS q FROM hosts)
    ), rejected AS (
      SELECT host FROM hosts, (SELECT m, CASE WHEN b > 0 THEN least({PRIOR_WEIGHT[1]}, greatest({PRIOR_WEIGHT[0]}, s / b - 1))
                                              ELSE {PRIOR_WEIGHT[1]} END AS k FROM prior)
      WHERE (f + m * k) / (n + k) > {max_rate}
    )
    SELECT * EXCLUDE (host, rid), NOT base_failed AND (host IS NULL OR host NOT IN (SELECT host FROM rejected)) AS kept
    FROM judged"""


ORACLE = {
    "op2_quality_rules": f"""
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
    FROM ({oracle_rules()})"""
}
