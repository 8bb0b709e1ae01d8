"""The queries of this folder by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import (
    bpe,
    exact_dedup,
    html_extraction,
    lm_scoring,
    mixing,
    quality,
    secrets_scan,
    simhash,
    substring_dedup,
    topk,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secrets_scan.op1_secret_scan,
        "op2_quality": quality.op2_quality,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_topk": topk.op4_topk,
        "op5_mixing": mixing.op5_mixing,
        "op6_bpe": bpe.op6_bpe,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_html_extraction": html_extraction.op8_html_extraction,
        "op9_lm_scoring": lm_scoring.op9_lm_scoring,
        "op10_simhash": simhash.op10_simhash,
        "pipeline": corpus_pipeline.run,
    }


def oracles() -> dict[str, str]:
    return {
        "op4_topk": topk.ORACLE,
        "op5_mixing": mixing.ORACLE,
        "op7_exact_dedup": exact_dedup.ORACLE,
    }
