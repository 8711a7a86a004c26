"""The operators' queries and their SQL, by the names that __spark_entry__ registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import fertility, jaccard_join, language_id, line_dedup, lm_scoring, mixing, packing, quality_classifier, secrets, top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.query,
    "op2_secrets": secrets.query,
    "op3_packing": packing.query,
    "op4_quality_classifier": quality_classifier.query,
    "op5_jaccard_join": jaccard_join.query,
    "op6_fertility": fertility.query,
    "op7_mixing": mixing.query,
    "op8_language_id": language_id.query,
    "op9_top_k": top_k.query,
    "op10_lm_scoring": lm_scoring.query,
    "op10_benchmark_scoring": lm_scoring.benchmark_query,
}

SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op3_packing": packing.SQL,
    "op5_jaccard_join": jaccard_join.SQL,
    "op7_mixing": mixing.SQL,
    "op9_top_k": top_k.SQL,
}
