"""The registered queries of the training-data operators, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import (
    centroids, curriculum, decontaminate, exact_dedup, language, line_dedup, minhash_dedup, periodic_runs,
    quality, substring_dedup, token_counts, token_records, url_filter,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_token_records": token_records.op4_token_records,
        "op5_quality": quality.op5_quality,
        "op6_curriculum": curriculum.op6_curriculum,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_language": language.op8_language,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_minhash_dedup": minhash_dedup.op10_minhash_dedup,
        "op11_periodic_runs": periodic_runs.op11_periodic_runs,
        "op12_line_dedup": line_dedup.op12_line_dedup,
        "op13_centroids": centroids.op13_centroids,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express (models and a tokenizer it cannot)."""
    return {
        "op3_substring_dedup": substring_dedup.OP3_SQL,
        "op6_curriculum": curriculum.OP6_SQL,
        "op9_exact_dedup": exact_dedup.OP9_SQL,
        "op10_minhash_dedup": minhash_dedup.OP10_SQL,
        "op12_line_dedup": line_dedup.OP12_SQL,
        "op13_centroids": centroids.OP13_SQL,
    }
