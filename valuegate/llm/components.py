"""Connected components of a link table by alternating large-star and small-star steps, in DataFrame operations only.

Kiveris et al., "Connected components in MapReduce and beyond", 2014. No node's neighbours are ever collected: a step is a
minimum for each node, pre-aggregated before its shuffle and joined back to the links. ``each_with`` gives that join an exchange on
both sides, so that adaptive execution deals a hub's links out over tasks. The driver gets counts alone, and few tasks to keep
book of: a step has no more exchanges than it needs, and a table that is settled is known by one aggregate instead of by another step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegate.llm.storage import written

MAX_ROUNDS = 60


def each_with(rows: DataFrame, known: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``known``, which has one row for each ``key`` (long), as an aggregate by that key has.

    An aggregate is dealt by the key already, so a join on the key reads it as it is, and adaptive execution splits a hot
    key only between two exchanges of the join itself. The join is therefore on the key's complement, by which neither side is
    dealt. ``known`` grows with the data and is never broadcast: its rows would pass through the driver.
    """
    turned = known.withColumn("_turned", F.bitwise_not(key)).drop(key)
    return rows.withColumn("_turned", F.bitwise_not(key)).join(turned.hint("merge"), "_turned", how).drop("_turned")


def _star(links: DataFrame) -> DataFrame:
    """Of links (a, b): each a with the least of itself and its neighbours."""
    return links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _step(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links with a > b."""
    # Large star: greater neighbours go to the least neighbour, which is a lesser one or the node itself.
    large = each_with(links, _star(links).withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
    # Small star: a node and its lesser neighbours go to the least of them.
    least = _star(large)
    moved = each_with(large, least, "a")
    small = moved.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every link (each listed once, a > b) hangs a node on the least node of its component.

    It does if no node has two lesser neighbours, and none has both a lesser and a greater one.
    """
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("lesser"), F.lit(0).alias("greater")).unionAll(links.select("b", F.lit(0), F.lit(1)))
    open_ = ends.groupBy("node").agg(F.sum("lesser").alias("lesser"), F.max("greater").alias("greater")).filter(F.col("lesser") + F.col("greater") > 1)
    return not open_.agg(F.count("*")).first()[0]


def stars(links: DataFrame) -> DataFrame:
    """(a, b) for every node of ``links`` (a, b: long) but the least of its component, which is b.

    Links may repeat, run either way or join a node to itself; nulls are ignored; an empty table gives an empty one. Each
    round is written to the shared folder, so lineage stays short and a lost executor costs one round at most. Stars that
    are given with few further links settle in as few rounds as those need.
    """
    ends = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    ends = ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    ends = written(ends, "links")
    for _ in range(MAX_ROUNDS):
        if _settled(ends):
            return ends
        ends = written(_step(ends), "links")
    raise RuntimeError("the components did not settle")


def named(ends: DataFrame) -> DataFrame:
    """(node, component) for every node of ``stars``."""
    roots = ends.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return ends.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links``, as ``stars`` takes them; the component is its least node."""
    return named(stars(links))
