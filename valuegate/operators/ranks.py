"""Exact medians without a task that holds a group: values are counted, sorted over all tasks, and found by how many stand before them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valuegate.sources.folders import stored


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on ``keys`` of which nulls are equal; of the keys those of ``left`` are returned."""
    renamed = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*(f"_{k}" for k in keys))


def medians(rows: DataFrame, keys: list[str], named: dict[str, Column]) -> DataFrame:
    """(keys, a column for each of ``named``): the median of every group, the mean of the two middle values of an even number; null without values.

    Equal values are one row with their count, so a value that many rows share is no load. The counts are dealt by ranges of
    group and value: a large group lies in many slices, one a task. The slices' totals, a row for each group and task, say in
    which slice a middle value stands, and only that slice is counted through.
    """
    each = F.array(*(F.struct(F.lit(i).alias("which"), c.cast("double").alias("v")) for i, c in enumerate(named.values())))
    group = [*keys, "which"]
    counts = rows.select(*keys, F.explode(each).alias("e")).select(*keys, "e.*").filter("v is not null").groupBy(*group, "v").agg(F.count("*").alias("n"))
    placed = stored(counts.repartitionByRange(*group, "v").sortWithinPartitions(*group, "v").withColumn("slice", F.spark_partition_id()), "value-counts")
    slices = placed.groupBy(*group, "slice").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*group)
    slices = slices.withColumns({"total": F.sum("n").over(whole), "before": F.sum("n").over(whole.orderBy("slice")) - F.col("n")})
    middle = F.explode(F.array_distinct(F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)))).alias("k")
    wanted = slices.select(*group, "slice", "n", "before", middle).filter((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("n"))).select(*group, "slice", (F.col("k") - F.col("before")).alias("k"))
    wanted = wanted.groupBy(*group, "slice").agg(F.collect_set("k").alias("ks"))  # one or two
    inside = same(placed, wanted, [*group, "slice"])
    upto = Window.partitionBy(*group, "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = inside.withColumn("upto", F.sum("n").over(upto))
    hit = counted.filter(F.exists("ks", lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("n"))))
    value = lambda i: F.min(F.when(F.col("which") == i, F.col("v"))) * 0.5 + F.max(F.when(F.col("which") == i, F.col("v"))) * 0.5
    return hit.groupBy(*keys).agg(*(value(i).alias(name) for i, name in enumerate(named)))
