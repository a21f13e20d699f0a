"""Joins by prefixes, substrings and cosines against all pairs, and how many rows they make."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from valuegate.operators import lookup, masking, search


def frame(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.fixture
def apart(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_numbers_follow_the_order(spark, apart):
    rng = random.Random(1)
    words = ["".join(rng.choice("abz") for _ in range(rng.randint(0, 6))) for _ in range(500)]
    rows = lookup.numbered(frame(spark, words, "s"), ["s"]).collect()
    assert [r["s"] for r in sorted(rows, key=lambda r: r["number"])] == sorted(words) and sorted(r["number"] for r in rows) == list(range(500))


def test_prefixes_as_by_all_pairs(spark, apart):
    rng = random.Random(2)
    made = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    words = {made(rng.randint(1, 9)) for _ in range(900)} | {"a", "zzz", "\U0010fffe"}
    tokens = {made(rng.randint(1, 4)) for _ in range(60)} | {"zz", "q", "\U0010fffe"}
    found = lookup.prefix_pairs(frame(spark, sorted(tokens) * 2, "token"), frame(spark, sorted(words) * 2, "word")).collect()
    want = {(t, w) for t in tokens for w in words if w.startswith(t)}
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    assert lookup.prefix_pairs(frame(spark, [], "token"), frame(spark, ["a"], "word")).count() == 0
    assert lookup.prefix_pairs(frame(spark, ["a"], "token"), frame(spark, [], "word")).count() == 0


def test_no_bin_is_hot(spark, apart):
    """Words that nearly all begin alike: the bins they are joined by stay equal, where their first three characters are one key."""
    words = [f"customer{k:06d}" for k in range(20_000)] + [f"{k:05d}x" for k in range(200)]
    placed = lookup.numbered(frame(spark, words, "s"), ["s"])
    sizes = sorted(r["count"] for r in placed.groupBy(F.shiftright("number", lookup.BIN)).count().collect())
    assert sizes[-1] <= 10 * sizes[len(sizes) // 2] and sizes[-1] == 1 << lookup.BIN
    tokens = ["customer0001", "customer01999", "cust", "000"]
    found = Counter(r["token"] for r in lookup.prefix_pairs(frame(spark, tokens, "token"), frame(spark, words, "word")).collect())
    assert found == {t: sum(w.startswith(t) for w in words) for t in tokens}


def test_substrings_as_by_all_pairs(spark, apart):
    rng = random.Random(3)
    made = lambda n: "".join(rng.choice("ab cé") for _ in range(n))
    texts = {made(rng.randint(0, 12)) for _ in range(300)} | {"aaaa", "", "a"}
    parts = {made(rng.randint(1, 5)) for _ in range(80)} | {"aaa", "aa", "a", "", "zzz", "abq"}
    found = lookup.substring_pairs(frame(spark, sorted(parts), "part"), frame(spark, sorted(texts), "text")).collect()
    want = {(p, t) for p in parts for t in texts if p and p in t}
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    assert lookup.substring_pairs(frame(spark, [], "part"), frame(spark, ["a"], "text")).count() == 0


def test_parts_are_looked_up_by_their_rarest_trigram(spark):
    """Values and mentions that share a frequent beginning: a mention meets the values that hold its rare end, not all of them."""
    values = [f"customer number {k:05d}" for k in range(3000)]
    mentions = [f"number {k:05d}" for k in range(0, 3000, 100)]
    given = frame(spark, mentions, "part"), frame(spark, values, "text")
    assert lookup.substring_pairs(*given).count() == len(mentions)
    assert lookup.rarest_met(*given).count() <= 0.01 * len(mentions) * len(values)


def test_spellings_count_values(spark):
    values = [("Aspirin", "a.x"), ("aspirin ec", "a.x"), ("ASPIRIN", "a.x"), ("Aspirin", "b.y"), ("other", "a.x")]
    mentions = [("aspirin", "a.x"), ("Aspirin", "b.y"), ("none", "a.x"), ("", "a.x"), ("OTHER", "a.x"), ("aspirin", "a.x")]
    got = {(r["mention"], r["ref"]): r["n"] for r in masking.spellings(spark.createDataFrame(mentions, "mention string, ref string"), spark.createDataFrame(values + values[:1], "value string, ref string")).collect()}
    assert got == {("aspirin", "a.x"): 3, ("Aspirin", "b.y"): 1, ("", "a.x"): 4, ("OTHER", "a.x"): 1}


def grams(text):
    padded = "  " + text.lower() + " "
    return Counter(padded[i : i + 3] for i in range(len(padded) - 2))


@pytest.mark.parametrize("least", [0.25, 0.6, 0.95])
def test_cosines_as_by_all_pairs(spark, least):
    rng = random.Random(5)
    stems = ["order", "customer", "part", "price", "key", "name", "status", "total", "market", "segment", "x"]
    phrase = lambda: " ".join(rng.choice(stems) + rng.choice(["", "s", "_id"]) for _ in range(rng.randint(1, 3)))
    ours, theirs = sorted({phrase() for _ in range(70)}), sorted({phrase() for _ in range(70)})
    vectors = lambda texts, name: search.trigram_vectors(frame(spark, texts, name), [name], F.col(name))
    left, right = vectors(ours, "mention"), vectors(theirs, "ref")
    shown = {name: {r[name]: r["vector"] for r in v.collect()} for name, v in (("mention", left), ("ref", right))}
    dot = lambda a, b: sum(w * b.get(g, 0.0) for g, w in a.items())
    want = {(m, r): dot(a, b) for m, a in shown["mention"].items() for r, b in shown["ref"].items()}
    assert all(abs(sum(w * w for w in v.values()) - 1) < 1e-9 for v in shown["mention"].values())
    got = {(r["mention"], r["ref"]): r["cos"] for r in lookup.cosine_pairs(left, "mention", right, ["ref"], least).collect()}
    assert got.keys() == {k for k, c in want.items() if c >= least - 1e-12} and all(math.isclose(c, want[k], abs_tol=1e-9) for k, c in got.items())


def test_frequent_trigrams_are_no_keys(spark):
    """Texts that end alike share trigrams without being alike: fewer pairs meet than share a trigram."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfghjklm") for _ in range(12))
    ours, theirs = [f"{word()} key" for _ in range(150)], [f"{word()} key" for _ in range(150)]
    vectors = lambda texts, name: search.trigram_vectors(frame(spark, texts, name), [name], F.col(name))
    left, right = vectors(ours, "mention"), vectors(theirs, "ref")
    found = lookup.cosine_pairs(left, "mention", right, ["ref"], 0.6)
    assert found.count() == 0
    pairs = lookup.rare_met(left, "mention", right, ["ref"], 0.6).count()
    shared = sum(bool(set(shown) & set(other)) for shown in map(grams, ours) for other in map(grams, theirs))
    assert shared == 150 * 150 and pairs <= 0.2 * shared
