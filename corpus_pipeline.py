"""A training-corpus pipeline over ``documents``: each stage calls one operator of ``valuegate.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from valuegate.llm import pipeline_stages as stages
from valuegate.llm.storage import table, written

#: (name, function). Each function takes (spark, docs, sf_dir); its rows are written and read again as the next one's docs.
STAGES = [
    ("toxicity", stages.toxicity),
    ("minhash near-dedup", stages.near_dedup),
    ("benchmark decontamination", stages.decontamination),
    ("secret scan", stages.secrets),
    ("packing", stages.packing),
]

#: Trained models and token ids are not expressible in SQL; the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
