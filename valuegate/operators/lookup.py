"""Joins of texts by what they share: prefixes as intervals of sorted words, substrings by their rarest trigram, vectors by their rare parts.

None of them has a key that many rows must share: what is frequent is only ever checked, never joined on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valuegate.operators.bloom import build as build_bloom
from valuegate.sources.folders import stored

#: Words of a bin: 2 to this power. A key of the prefix join stands for one bin.
BIN = 6
#: Greater than every character that words hold.
LAST = "\U0010ffff"


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows``, written, with ``number``: their places in sorted order, without a task that sees all of them. The table of offsets is a row a partition."""
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_row"))
    placed = stored(placed, "sorted")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn("number", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def prefix_pairs(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, word): distinct words that begin with distinct tokens.

    Sorted among the words, a token and the token with the greatest character behind it bound an interval, and just the words
    between begin with it. Words fall into bins of equal size; a token meets the bins that its interval covers, so there are about as
    many keys as matches, and a bin is met by no more tokens than its words have prefixes.
    """
    none = F.lit(None).cast("string")
    ends = tokens.select("token").distinct()
    rows = words.select(F.col("word").alias("s"), F.lit(1).alias("kind"), none.alias("token")).distinct()
    rows = rows.unionAll(ends.select("token", F.lit(0), "token")).unionAll(ends.select(F.concat("token", F.lit(LAST)), F.lit(2), "token"))
    placed = numbered(rows, ["s", "kind"])
    spans = placed.filter("kind <> 1").groupBy("token").agg(F.min("number").alias("low"), F.max("number").alias("high")).filter(F.col("high") - F.col("low") > 1)
    covers = spans.withColumn("bin", F.explode(F.sequence(F.shiftright("low", BIN), F.shiftright("high", BIN))))
    binned = placed.filter("kind = 1").select(F.col("s").alias("word"), "number", F.shiftright("number", BIN).alias("bin"))
    return covers.join(binned, "bin").filter((F.col("number") > F.col("low")) & (F.col("number") < F.col("high"))).select("token", "word")


def _stretches(text: Column, size: int) -> Column:
    """array<struct<at, gram>>: every stretch of ``size`` characters and where it begins."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.substring(text, i, F.lit(size)).alias("gram")))


def rarest_met(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """(part, offset, text, at): texts that hold the rarest trigram of a part, where it stands in the part and in the text.

    A part is looked up by its rarest trigram (one that no text holds rules it out); a shorter part is its own gram. A filter of the
    grams that are looked up goes over the texts first, so they give postings for those alone.
    """
    asked = parts.select("part").filter("part <> ''").distinct()
    held = texts.select("text").filter("text <> ''").distinct()
    grams = lambda text: F.concat(*(_stretches(text, n) for n in (1, 2, 3)))
    own = F.when(F.length("part") >= 3, _stretches(F.col("part"), 3)).otherwise(F.array(F.struct(F.lit(1).alias("at"), F.col("part").alias("gram"))))
    wanted = asked.select("part", F.explode(own).alias("g")).select("part", "g.*")
    # How many texts hold a gram: summed where the texts are, so a row a gram and task is shuffled; the grams of an alphabet are few.
    rarity = held.select(F.explode(F.array_distinct(F.transform(grams(F.col("text")), lambda g: g["gram"]))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    best = wanted.join(rarity, "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "at")).alias("g"))
    best = stored(best.filter("g.n > 0").select("part", "g.gram", F.col("g.at").alias("offset")), "rarest")
    looked = build_bloom(best.select(F.xxhash64("gram").alias("key")).distinct())
    postings = F.filter(grams(F.col("text")), lambda g: looked.may_hold(F.xxhash64(g["gram"])))
    postings = held.select("text", F.explode(postings).alias("p")).select("text", "p.*")
    return best.join(postings, "gram").drop("gram")


def substring_pairs(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """(part, text): distinct texts that hold distinct, non-empty parts: where the rarest trigram stands, the rest of the part is compared."""
    met, begin = rarest_met(parts, texts), F.col("at") - F.col("offset") + 1
    return met.filter((begin > 0) & (F.substring("text", begin, F.length("part")) == F.col("part"))).select("part", "text").distinct()


def unit_vectors(rows: DataFrame, keys: list[str], grams: Column) -> DataFrame:
    """(keys, vector: map<gram, weight>) of unit length from arrays of grams that may repeat; rows without grams go."""
    counted = rows.select(*keys, F.explode(grams).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("n"))
    vectors = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("gram", F.col("n").cast("double")))).alias("v"))  # a text's own grams
    norm = lambda v: F.sqrt(F.aggregate(F.map_values(v), F.lit(0.0), lambda acc, x: acc + x * x))
    return vectors.withColumn("norm", norm(F.col("v"))).select(*keys, F.transform_values("v", lambda _, x: x / F.col("norm")).alias("vector"))


def cosine(a: Column, b: Column) -> Column:
    """Of two unit vectors, null as 0."""
    dot = F.aggregate(F.map_keys(a), F.lit(0.0), lambda acc, g: acc + F.element_at(a, g) * F.coalesce(F.try_element_at(b, g), F.lit(0.0)))
    return F.coalesce(dot, F.lit(0.0))


def rare_met(asked: DataFrame, key: str, others: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(key, keys): the pairs of unit vectors (``vector``) that may have a cosine of ``least`` or more.

    The grams of each of ``others`` go from the most frequent to the rarest; while what they could add to any cosine at most
    stays under ``least``, they are no keys (Bayardo et al., "Scaling up all pairs similarity search", 2007). A pair that reaches
    it shares one of the rest, the rare ones.
    """
    ours = asked.select(key, F.explode("vector").alias("gram", "w"))
    theirs = others.select(*keys, F.explode("vector").alias("gram", "w"))
    most = ours.groupBy("gram").agg(F.max("w").alias("most"), F.count("*").alias("n"))
    # A gram that no asked vector has adds nothing and is no key.
    rated = theirs.join(most, "gram").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "gram", (F.col("w") * F.col("most")).alias("b")))).alias("gs"))
    zero = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<string>").alias("rare"))
    # Rounding must not lose a pair at the bound.
    cut = F.aggregate("gs", zero, lambda acc, g: F.struct((acc["sum"] + g["b"]).alias("sum"), F.when(acc["sum"] + g["b"] >= least - 1e-9, F.concat(acc["rare"], F.array(g["gram"]))).otherwise(acc["rare"]).alias("rare")), lambda acc: acc["rare"])
    index = rated.select(*keys, F.explode(cut).alias("gram"))
    return ours.select(key, "gram").join(index, "gram").select(key, *keys).distinct()


def cosine_pairs(asked: DataFrame, key: str, others: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(key, keys, cos): the pairs of unit vectors (``vector``) of a cosine of ``least`` or more; those that ``rare_met`` lets meet are compared in full."""
    met = rare_met(asked, key, others, keys, least)
    both = met.join(asked.select(key, F.col("vector").alias("_a")), key).join(others.select(*keys, F.col("vector").alias("_b")), keys)
    return both.select(key, *keys, cosine(F.col("_a"), F.col("_b")).alias("cos")).filter(F.col("cos") >= least - 1e-12)
