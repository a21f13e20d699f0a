"""Tables that are given, and intermediate ones in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from valuegate.sources.folders import discard, new_folder
from valuegate.sources.folders import stored as written

__all__ = ["discard", "new_folder", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
