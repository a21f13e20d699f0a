"""Copy of an export into the working folder, with a report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from valuegate.operators.relational import row_counts
from valuegate.sources.folders import new_folder


def ingest(tables: dict[str, DataFrame], folder: str | None = None) -> DataFrame:
    """Write each table with lower-case column names as Parquet and return (table_name, n_rows) of what was written."""
    spark = next(iter(tables.values())).sparkSession
    folder = folder or new_folder(spark, "ingest")
    for name, frame in tables.items():
        frame.toDF(*(c.lower() for c in frame.columns)).write.parquet(f"{folder}/{name}.parquet")
    return row_counts({name: spark.read.parquet(f"{folder}/{name}.parquet") for name in tables})
