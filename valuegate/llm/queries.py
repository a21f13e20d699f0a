"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from valuegate.llm import (
    op1_embedding_near_dedup,
    op2_token_counts,
    op3_decontamination,
    op4_bit_packing,
    op5_packing,
    op6_toxicity,
    op7_substring_dedup,
    op8_warc_derivatives,
    op9_minhash_near_dedup,
    op10_secret_scan,
    op11_chat_formatting,
    op12_embedding_whitening,
    op13_conversation_repair,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup.query,
    "op2_token_counts": op2_token_counts.query,
    "op3_decontamination": op3_decontamination.query,
    "op4_bit_packing": op4_bit_packing.query,
    "op5_packing": op5_packing.query,
    "op6_toxicity": op6_toxicity.query,
    "op7_substring_dedup": op7_substring_dedup.query,
    "op8_warc_derivatives": op8_warc_derivatives.query,
    "op9_minhash_near_dedup": op9_minhash_near_dedup.query,
    "op10_secret_scan": op10_secret_scan.query,
    "op11_chat_formatting": op11_chat_formatting.query,
    "op12_embedding_whitening": op12_embedding_whitening.query,
    "op13_conversation_repair": op13_conversation_repair.query,
}

ORACLE_SQL: dict[str, str] = {"op8_warc_derivatives": op8_warc_derivatives.ORACLE_SQL, "op11_chat_formatting": op11_chat_formatting.ORACLE_SQL}
