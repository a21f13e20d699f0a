"""The value index: the distinct values of vocabulary columns, and what is derived from them."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuegate.sources.local import local_rows

SHORT_WORDS = 3
NGRAM_FLOOR, NGRAM_CEILING = 6, 32
#: Numbers written as words.
NUMERALS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand".split()


def normal(value: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.lower(F.regexp_replace(F.trim(value), r"\s+", " "))


def build(tables: dict[str, DataFrame], tiers: DataFrame, tier: str = "A") -> DataFrame:
    """(value, ref): the distinct trimmed values of the columns of a tier; blanks are no values.

    The tiers are a row for each column, so they are read to know which columns to scan.
    """
    chosen = sorted((r["table_name"], r["column_name"]) for r in tiers.filter(F.col("tier") == tier).select("table_name", "column_name").collect())
    parts = []
    for table in dict.fromkeys(t for t, _ in chosen):  # a scan a table, one shuffle for all
        each = F.array(*(F.struct(F.trim(c).alias("value"), F.lit(f"{t}.{c}").alias("ref")) for t, c in chosen if t == table))
        parts.append(tables[table].select(F.explode(each).alias("v")).select("v.*"))
    if not parts:
        return local_rows(next(iter(tables.values())).sparkSession, [], "value string, ref string")
    return reduce(DataFrame.unionAll, parts).filter("value <> ''").distinct()


def write(index: DataFrame, folder: str) -> None:
    """Parquet by column reference, so that a scoped search reads only its columns."""
    index.write.partitionBy("ref").mode("overwrite").parquet(folder)


def words(values: DataFrame) -> DataFrame:
    """(word): words of three characters or more of the values of a column that is resolved on demand."""
    return values.select(F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-zà-ÿ0-9]{3,}"), F.lit(0))).alias("word")).distinct()


def stats(tiers: DataFrame, index: DataFrame) -> DataFrame:
    """(measure, n): columns by tier and values in the index."""
    by = tiers.groupBy(F.coalesce("tier", F.lit("none")).alias("tier")).agg(F.count("*").alias("n")).select(F.concat(F.lit("tier "), "tier").alias("measure"), "n")
    return by.unionAll(index.agg(F.count("*").alias("n")).select(F.lit("values"), "n"))


def report(tiers: DataFrame, index: DataFrame) -> DataFrame:
    """The tiers with n_indexed: how many values of each column the index holds."""
    sizes = index.groupBy("ref").agg(F.count("*").alias("n_indexed"))
    joined = tiers.withColumn("ref", F.concat_ws(".", "table_name", "column_name")).join(sizes, "ref", "left")
    return joined.select("table_name", "column_name", "tier", "n_distinct", "reason", F.coalesce("n_indexed", F.lit(0)).alias("n_indexed"))


def exact_values(index: DataFrame) -> DataFrame:
    return index.select(normal(F.col("value")).alias("value")).distinct()


def value_tokens(index: DataFrame, tier_b_words: DataFrame | None = None) -> DataFrame:
    """(token): words of three characters or more inside short values, and the words of tier B."""
    short = index.filter(F.size(F.regexp_extract_all("value", F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))) <= SHORT_WORDS)
    tokens = short.select(F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-zà-ÿ0-9]{3,}"), F.lit(0))).alias("token"))
    if tier_b_words is not None:
        tokens = tokens.unionAll(tier_b_words.select("word"))
    return tokens.distinct()


def longest_value_words(exact: DataFrame) -> DataFrame:
    longest = F.max(F.size(F.split("value", " ")))
    return exact.agg(F.least(F.greatest(F.coalesce(longest, F.lit(0)), F.lit(NGRAM_FLOOR)), F.lit(NGRAM_CEILING)).alias("n_words"))


def carries_information(value: Column) -> Column:
    """Whether disclosing the text can teach anything: three characters or more, no numeral, some letter."""
    text = F.trim(F.coalesce(value, F.lit("")))
    return (F.length(text) >= 3) & ~F.lower(text).isin(NUMERALS) & text.rlike(r"\p{L}")


def bloom_size(expected: int, error: float = 0.01) -> tuple[int, int]:
    """Bits and hash functions for so many items."""
    expected = max(expected, 1)
    bits = max(8, int(-expected * math.log(error) / math.log(2) ** 2))
    return bits, max(1, round(bits / expected * math.log(2)))


def _positions(item: Column, bits: int, hashes: int) -> Column:
    """Double hashing from the digest's first two eights of hex digits."""
    digest = F.sha2(item, 256)
    one, two = (F.conv(F.substring(digest, a, 8), 16, 10).cast("long") for a in (1, 9))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (one + i * (two.bitwiseOR(1))) % bits)


def bloom(items: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """(byte, bits): the filter as a table of its bytes that are not zero."""
    place = items.select(F.explode(_positions(F.col(column), bits, hashes)).alias("p"))
    return place.groupBy(F.floor(F.col("p") / 8).alias("byte")).agg(F.bit_or(F.pow(F.lit(2), F.col("p") % 8).cast("int")).alias("bits"))


def probe(items: DataFrame, column: str, filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(column, present) of distinct items: false is certain, true may be wrong."""
    place = items.select(column).distinct().select(column, F.explode(_positions(F.col(column), bits, hashes)).alias("p"))
    place = place.withColumn("byte", F.floor(F.col("p") / 8)).join(filter_, "byte", "left")
    hit = F.expr("coalesce(bits, 0) & cast(pow(2, p % 8) AS int)") != 0
    return place.groupBy(column).agg(F.bool_and(hit).alias("present"))
