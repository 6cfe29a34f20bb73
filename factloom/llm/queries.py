"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import exact_dedup, line_dedup, mixing, near_dedup, sentencepiece_wfst, sharding, token_counts, topk, toxicity, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_sentencepiece": sentencepiece_wfst.op2_sentencepiece,
    "op3_topk": topk.op3_topk,
    "op4_sharding": sharding.op4_sharding,
    "op5_minhash": near_dedup.op5_minhash,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_url_filters": url_filters.op10_url_filters,
}

ORACLES: dict[str, str] = {
    "op3_topk": topk.ORACLE_SQL,
    "op5_minhash": near_dedup.ORACLE_SQL,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
    "op8_exact_dedup": exact_dedup.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
    "op10_url_filters": url_filters.ORACLE_SQL,
}
