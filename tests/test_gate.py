"""The gate's plan against plain versions: the filter, the walk of the trie, columns beyond the index, and kept tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from valuegate.operators import bloom, gate
from valuegate.operators import index as ix
from valuegate.operators import profile as pf
from valuegate.sources.kept import kept, listing


@pytest.mark.parametrize("most", [bloom.MOST_BYTES, 64, 7])
def test_a_filter_holds_all_its_keys(spark, most):
    """However crowded it is, nothing that was put in is missed; with room, few others pass."""
    keys = spark.range(5000).select(F.xxhash64(F.concat(F.lit("k"), "id")).alias("key"))
    made = bloom.build(keys, most_bytes=most)
    assert len(made.data) <= max(most, bloom.LEAST_BYTES)
    assert keys.filter(~made.may_hold(F.col("key"))).count() == 0
    others = spark.range(20_000).select(F.xxhash64(F.concat(F.lit("other"), "id")).alias("key"))
    passed = others.filter(made.may_hold(F.col("key"))).count()
    assert passed <= 20_000 * (2 * made.share**bloom.HASHES + 0.002)
    if most == bloom.MOST_BYTES:
        assert passed < 400
    assert others.filter(bloom.build(keys.limit(0)).may_hold(F.col("key"))).count() == 0


def stretches(text, most=32):
    words = re.findall(gate.WORD.replace("A-Z", ""), (text or "").lower())
    return [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def plain_known(texts, values, exempt):
    ours = {v for v in values if len(v.split(" ")) <= 32}
    numerals = set(ix.NUMERALS)
    told = lambda v: " " in v or (v not in exempt and len(v.strip()) >= 3 and v not in numerals and any(c.isalpha() for c in v))
    return {(k, v, len(v.split(" "))) for k, t in texts.items() for v in set(stretches(t)) if v in ours and told(v)}


def many(seed):
    rng = random.Random(seed)
    words = ["the", "small", "ring", "of", "north", "gate", "a.b", "é1", "x", "12", "three", "order", "c++"]
    phrase = lambda n: " ".join(rng.choice(words) for _ in range(n))
    values = {phrase(rng.choice([1, 1, 2, 2, 3, 5])) for _ in range(60)} | {"the " * 31 + "end", "the " * 32 + "end", "with, comma"}
    texts = {k: f"{phrase(rng.randint(0, 12))}, {rng.choice(sorted(values)).upper()}  {phrase(rng.randint(0, 9))}" for k in range(120)} | {500: None, 501: "", 502: "the " * 40 + "end", 503: "with, comma"}
    return values, texts, {"order", "ring"}


@pytest.mark.parametrize("most", [bloom.MOST_BYTES, bloom.LEAST_BYTES])
def test_known_values_as_by_every_stretch(spark, monkeypatch, most):
    """The walk finds what enumerating all stretches of all lengths finds, also with a filter far too small: it never lets a value pass."""
    values, texts, exempt = many(4)
    made = bloom.build
    monkeypatch.setattr(gate, "build_bloom", lambda keys: made(keys, most_bytes=most))
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    denied = gate.denied_values(frame([(v,) for v in values], "value string"), frame([(w,) for w in exempt], "word string"))
    deny = gate.denylist(denied, frame([], "token string"))
    docs = frame(list(texts.items()), "id long, text string")
    want = plain_known(texts, values, exempt)
    assert {tuple(r) for r in gate.known_values(docs, deny).collect()} == want and len(want) > 100
    monkeypatch.setattr(gate, "SENT_VALUES", -1)
    assert {tuple(r) for r in gate.known_values(docs, gate.denylist(denied, frame([], "token string"))).collect()} == want
    # Rows before any join: little more than what is found, where every stretch of every length was a row before.
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(gate.WORD.replace("A-Z", "")), F.lit(0))
    rows = docs.select(words.alias("ws")).select(F.explode(gate.trie_matches(F.col("ws"), deny))).count()
    assert len(want) <= rows <= sum(len(set(stretches(t))) for t in texts.values())
    if most == bloom.MOST_BYTES:
        assert rows <= 1.05 * len(want) < 0.05 * sum(len(set(stretches(t))) for t in texts.values())


def test_refused_tokens_as_by_lookup(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = ["building", "Automobile", "ring", "order", "three", "ab", "x1", "é1a", "12", "north_gate", ":v1", "%"]
    texts = {k: " ".join(rng.choice(vocabulary).swapcase() if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randint(0, 15))) for k in range(80)} | {900: None}
    tokens, allowed = {"building", "automobile", "order", "three", "ab", "north_gate", "é1a"}, {"order"}
    want = set()
    for k, text in texts.items():
        seen = set()
        for place, token in enumerate(re.findall(gate.TOKEN, text or "")):
            key = token.lower()
            if key in seen or any(re.search(p, token) for p in gate.PATTERNS) or len(key) < 3 or key in ix.NUMERALS or key not in tokens or key in allowed:
                continue
            seen.add(key)
            want.add((k, token, place))
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    denied = gate.denied_tokens(frame([(t,) for t in tokens], "token string"), frame([(w,) for w in allowed], "word string"))
    for most in (bloom.MOST_BYTES, 64):
        made = bloom.build
        monkeypatch.setattr(gate, "build_bloom", lambda keys, m=most, made=made: made(keys, most_bytes=m))
        deny = gate.denylist(frame([], "value string, size int"), denied)
        assert {tuple(r) for r in gate.refused_tokens(frame(list(texts.items()), "id long, text string"), deny).collect()} == want
        monkeypatch.setattr(gate, "build_bloom", made)


def test_a_column_beyond_the_index_still_blocks(spark):
    """5,000 values are indexed, 5,001 are resolved on demand; the gate knows their words either way."""
    for n, tier in ((5000, "A"), (5001, "B")):
        rows = spark.range(4 * n).select(F.concat(F.lit("zebra"), F.col("id") % n, F.lit(" wing")).alias("name"))
        tables = {"places": rows}
        tiers = pf.column_tiers(tables)
        assert [r["tier"] for r in tiers.collect()] == [tier]
        index, beyond = ix.build(tables, tiers), ix.words(ix.build(tables, tiers, "B"))
        allowed = spark.createDataFrame([("please",)], "word string")
        deny = gate.denylist(gate.denied_values(ix.exact_values(index), allowed), gate.denied_tokens(ix.value_tokens(index, beyond), allowed))
        texts = spark.createDataFrame([(1, "please open ZEBRA17 now"), (2, "please open it now")], "id long, text string")
        got = {r["id"]: (r["allowed"], r["refused"]) for r in gate.verdicts(texts, gate.known_values(texts, deny), gate.refused_tokens(texts, deny)).collect()}
        assert got == {1: (False, ["ZEBRA17"]), 2: (True, [])}


def test_kept_tables_follow_their_files(spark, tmp_path):
    source = f"file://{tmp_path}/t.parquet"
    spark.range(3).write.parquet(source)
    calls = []

    def make():
        calls.append(1)
        return spark.read.parquet(source).select(F.col("id").cast("string").alias("a"), (F.col("id") % 2).alias("b"))

    read = lambda: sorted(r["a"] for r in kept(spark, "test", listing(spark, [source]), "a string, b long", make, ["b"]).collect())
    assert read() == read() == ["0", "1", "2"] and len(calls) == 1
    spark.range(7, 8).write.mode("append").parquet(source)
    assert read() == ["0", "1", "2", "7"] and len(calls) == 2
    assert kept(spark, "none", "v", "a string", lambda: spark.createDataFrame([], "a string")).count() == 0
