"""Exact medians against Spark's own, which hold a group in one task."""

import random

import pytest
from pyspark.sql import functions as F

from valuegate.operators import ranks
from valuegate.sources.folders import stored

KIND = "g string, h long, v double, w double"


@pytest.fixture
def apart(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def rows(seed):
    rng = random.Random(seed)
    value = lambda: None if rng.random() < 0.1 else rng.choice([1.5, 1.5, 7.0, float("inf"), -3.25, rng.uniform(-9, 9)])
    out = [("hot", rng.choice([1, 2]), value(), rng.uniform(0, 1)) for _ in range(3000)]
    out += [(rng.choice(["a", "b", None, "c"]), rng.choice([None, 1]), value(), value()) for _ in range(200)]
    return out + [("one", 1, 4.0, None), ("none", 1, None, None), ("two", 1, 1.0, 2.0), ("two", 1, 2.0, 2.0)]


@pytest.mark.parametrize("keys", [[], ["g"], ["g", "h"]])
def test_medians_are_exact(spark, apart, keys):
    frame = spark.createDataFrame(rows(3), KIND)
    got = {tuple(r[k] for k in keys): (r["v"], r["w"]) for r in ranks.medians(frame, keys, {"v": F.col("v"), "w": F.when(F.col("w") > 0, F.col("w"))}).collect()}
    want = {tuple(r[k] for k in keys): (r["v"], r["w"]) for r in frame.groupBy(*keys).agg(F.median("v").alias("v"), F.median(F.when(F.col("w") > 0, F.col("w"))).alias("w")).collect()}
    assert {k: v for k, v in want.items() if v != (None, None)} == got


def test_a_large_group_lies_in_many_slices(spark, apart, monkeypatch):
    """A group of nearly all rows: its values are dealt over all tasks, and a value that a third of the rows share is one row."""
    seen = []
    monkeypatch.setattr(ranks, "stored", lambda df, name: seen.append(stored(df, name)) or seen[-1])
    frame = spark.range(30_000).select(F.lit("hot").alias("g"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.rand(1)).alias("v"))
    got = ranks.medians(frame, ["g"], {"v": F.col("v")}).first()["v"]
    assert got == frame.agg(F.median("v")).first()[0]
    sizes = sorted(r["count"] for r in seen[0].groupBy("slice").count().collect())
    assert len(sizes) == 6 and sum(sizes) == 20_001 and sizes[-1] <= 2 * sizes[0]
