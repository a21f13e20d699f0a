"""Small tables made on the driver, as part of the plan: no job of their own, and of known size to the optimizer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A frame of ``rows``, which grow with a schema or a dictionary and never with the data."""
    schema = T.StructType.fromDDL(ddl)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=to_arrow_schema(schema)))
