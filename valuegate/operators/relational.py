"""Small relational operators: predicates, shares, ranked groups and bounded results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows), one aggregation a table."""
    counts = [frame.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, frame in tables.items()]
    return reduce(DataFrame.unionAll, counts)


def contains_ci(column: str, part: str) -> Column:
    """Whether the text holds ``part``, whatever the case."""
    return F.contains(F.lower(column), F.lit(part.lower()))


def nonblank(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.isNotNull() & (F.trim(column) != "")


def dirty_int(column: str) -> Column:
    """The whole number that a text states, 0 where it states none."""
    return F.coalesce(F.expr(f"try_cast({column} AS int)"), F.lit(0))


def minutes_to_days(column: str) -> Column:
    return F.col(column) / F.lit(1440.0)


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def rows_per(entity: str) -> Column:
    return F.count("*").cast("double") / F.count_distinct(entity)


def having_all(hub: DataFrame, facts: list[DataFrame], key: str) -> DataFrame:
    """Rows of ``hub`` that every fact table has an entry for: semi joins, so no fan-out."""
    return reduce(lambda df, fact: df.join(fact.select(key), key, "left_semi"), facts, hub)


def top_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, ties by value."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def at_maximum(df: DataFrame, column: str) -> DataFrame:
    """All rows at the column's maximum. The maximum is one row, so the join is by broadcast whatever the table's size."""
    top = df.agg(F.max(column).alias(column))
    return df.join(F.broadcast(top), column, "left_semi")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= k).drop("_rank")


def capped(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` rows and whether there were more: one row too many is fetched, nothing is counted."""
    first = df.orderBy(order).limit(n + 1)
    place = Window.orderBy(order)  # over n + 1 rows
    numbered = first.withColumn("_place", F.row_number().over(place)).withColumn("_all", F.count("*").over(Window.partitionBy()))
    return numbered.filter(F.col("_place") <= n).withColumn("truncated", F.col("_all") > n).drop("_place", "_all")


def filled_cells(df: DataFrame) -> DataFrame:
    """How many cells of a result are not null."""
    return df.agg(reduce(Column.__add__, [F.count(c) for c in df.columns]).alias("cells"))
