"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import (
    bpe,
    embedding_dedup,
    html_text,
    license_scan,
    line_dedup,
    ngram_join,
    packing,
    quality_model,
    quality_rules,
    warc,
)


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_warc": warc.op4_warc,
        "op5_quality_model": quality_model.op5_quality_model,
        "op6_bpe": bpe.op6_bpe,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
        "op9_html_text": html_text.op9_html_text,
        "op10_packing": packing.op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return quality_rules.ORACLE | warc.ORACLE | line_dedup.ORACLE
