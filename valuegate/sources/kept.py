"""Tables derived from given ones and kept between queries: made again only when the files that they came from change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegate.sources.folders import new_folder, shared_folder

def listing(spark: SparkSession, paths: list[str]) -> str:
    """What tells the present files of ``paths`` from any others: their names, sizes and times. Only directories are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")
    row = files.agg(F.count("*").alias("n"), F.sum("length").alias("size"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("mark")).first()
    return f"{row['n']}-{row['size'] or 0}-{int(row['mark'] or 0) & (1 << 128) - 1:x}"


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _file_system(spark, path)
    return system.exists(where)


def moved(spark: SparkSession, draft: str, place: str) -> bool:
    """Moves a written folder into place at once; where another has come first, it stays aside."""
    system, where = _file_system(spark, place)
    system.mkdirs(where.getParent())
    first = not system.exists(where) and system.rename(_file_system(spark, draft)[1], where)
    if not first and not system.exists(where):
        raise OSError(f"{draft} could not be moved to {place}")
    return first


def kept(spark: SparkSession, name: str, version: str, schema: str, make: Callable[[], DataFrame], partition_by: list[str] | None = None) -> DataFrame:
    """The table ``name`` of this version of its sources: read where it is whole, else made, written beside and moved into place."""
    folder = f"{shared_folder(spark)}/kept/{version}/{name}"
    if not exists(spark, f"{folder}/_SUCCESS"):
        draft = new_folder(spark, f"draft-{name}")
        frame = make()
        (frame.write.partitionBy(*partition_by) if partition_by else frame.write).parquet(draft)
        moved(spark, draft, folder)
    return spark.read.schema(schema).parquet(folder)
