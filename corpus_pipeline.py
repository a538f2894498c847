"""The corpus pipeline: rules, classifier, line dedup, near-duplicate join, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fitlake.llm import line_dedup, ngram_join, packing, quality_model, quality_rules
from fitlake.llm.scratch import materialize

#: Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again.
STAGES = [
    ("quality rules", quality_rules.stage),
    ("quality classifier", quality_model.stage),
    ("line dedup", line_dedup.stage),
    ("n-gram join", ngram_join.stage),
    ("best-fit packing", packing.stage),
]

#: A trained classifier and a packing by sums of squares are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs
