"""What grows with the tables is neither paired nor taken apart in shuffles."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from valuegate.functions import text as tx
from valuegate.operators import bloom, gate
from valuegate.operators import journal as jr
from valuegate.operators import search as se


def test_pieces_are_counted_where_their_name_stands(spark, sf_dir):
    import __spark_entry__

    found = __spark_entry__.queries()["fn_trigrams"](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "gram" not in " ".join(re.findall(r"hashpartitioning\(([^)]*)\)", plan)) and "hashpartitioning(p_partkey" in plan
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["a"]), (4, ["", "", "c", ""])], "id int, items array<string>")
    got = {r["id"]: [tuple(c) for c in r["c"] or []] for r in rows.select("id", tx.counted(F.col("items")).alias("c")).collect()}
    assert got == {1: [("a", 1), ("b", 2)], 2: [], 3: [("a", 1)], 4: [("", 3), ("c", 1)]}


def test_bm25_in_blocks(spark, monkeypatch):
    """As by a plain loop, whatever the blocks; ties by document, ids that repeat are one document, and pairs of query and document are no rows."""
    random.seed(5)
    words = [f"w{i}" for i in range(40)]
    docs = [(random.randint(0, 90), random.choice(words[: random.choice([3, 40])])) for _ in range(1500)] + [(None, "w1"), (200, "unasked")]
    asked = [(q, random.choice(words + ["nowhere"])) for q in range(23) for _ in range(5)] + [(None, "w1"), (50, "nowhere")]
    docs += [(300 + i, "w7") for i in range(40)]
    tf, size = Counter(docs), Counter(d for d, _ in docs)
    avg, df = sum(size.values()) / len(size), Counter(t for _, t in tf)
    want = set()
    for q in {q for q, _ in asked}:
        score = Counter()
        for t in {t for p, t in asked if p == q}:
            for d in size:
                if d is not None and (n := tf[d, t]):
                    score[d] += math.log(1 + (len(size) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size[d] / avg))
        want |= {(q, d, round(s, 6)) for d, s in sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:10]}
    q, d = spark.createDataFrame(asked, "query int, token string"), spark.createDataFrame(docs, "doc long, token string").repartition(3)
    for sizes in ((2048, 128), (7, 4)):
        monkeypatch.setattr(se, "BLOCK_DOCUMENTS", sizes[0])
        monkeypatch.setattr(se, "BLOCK_QUERIES", sizes[1])
        found = se.bm25(q, d)
        assert {tuple(r) for r in found.collect()} == want
        assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_parts_are_shuffled_for_no_identifier(spark):
    """Parts that name identifiers are judged where they stand, each by itself, also without an id."""
    parts = [(1, 1, "schema", "CREATE TABLE orders (o_key INT)"), (1, 2, "schema", "CREATE TABLE orders (o_shade INT)"), (1, 3, "params", ":v1 = a value of orders.o_key"), (2, 1, "params", ":v1 = a value of orders.o_shade"), (None, 1, "schema", "CREATE TABLE orders (o_shade INT)"), (2, 1, "schema", None), (3, 1, "params", None), (3, 2, "params", "  (none)")]
    segments = spark.createDataFrame(parts, "id long, part int, origin string, text string")
    one = lambda kind, *rows: spark.createDataFrame([(r,) for r in rows], f"{kind} string")
    found = gate.provenance(segments, one("digest"), one("digest"), one("word", "orders", "o_key"), one("note"))
    assert [r["rule"] for r in found.collect()] == [gate.RULES["schema"], None, gate.RULES["params"], None, None, None, None, gate.RULES["params"]]
    assert "hashpartitioning(id" not in found._jdf.queryExecution().executedPlan().toString()


def test_parts_with_a_rule_meet_no_verdict(spark):
    parts = spark.createDataFrame([(1, 1, "r"), (1, 2, None), (1, 3, None), (2, 1, "r"), (2, 2, "r"), (3, 1, None), (4, 1, None), (None, 1, "r")], "id long, part int, rule string")
    checked = spark.createDataFrame([(1, 2, False, ["b", "a"]), (1, 3, False, ["a"]), (2, 1, False, ["x"]), (3, 1, True, [])], "id long, part int, allowed boolean, refused array<string>")
    found = gate.message_verdicts(parts, checked)
    assert {tuple(map(str, r)) for r in found.collect()} == {("1", "False", "['a', 'b']"), ("2", "True", "[]"), ("3", "True", "[]"), ("4", "False", "[]"), ("None", "True", "[]")}
    joins = found._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert "isnull(rule" in joins


def test_texts_are_tested_in_batches_and_stay_where_they_are(spark):
    """Filters are tested by whole batches, with the same answers as one by one; journal lines shuffle no text."""
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    made, others = bloom.build(keys, most_bytes=900), spark.range(9000).select(F.xxhash64("id").alias("key"))
    rows = others.select("key", made.may_hold(F.col("key")).alias("held")).toPandas()
    assert (made.holds(rows["key"].to_numpy().view(np.uint64)) == rows["held"].to_numpy()).all() and 0 < (~rows["held"]).sum() < 6001
    frame = spark.createDataFrame
    deny = gate.denylist(frame([("red ring", 2), ("ring", 1)], "value string, size int"), frame([("ring",)], "token string"))
    texts = frame([(1, "The Red Ring, a ring"), (2, None), (3, "red"), (4, "")], "id long, text string")
    known, refused = gate.known_values(texts, deny), gate.refused_tokens(texts, deny)
    assert {tuple(r) for r in known.collect()} == {(1, "ring", 1), (1, "red ring", 2)} and {tuple(r) for r in refused.collect()} == {(1, "Ring", 2)}
    for found in (known, refused):
        assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    lines = jr.verdict_lines(gate.verdicts(texts, known, refused), texts, "c", F.current_timestamp())
    assert {(r["length"], r["allowed"]) for r in lines.collect()} == {(20, False), (0, True), (3, True)}
    assert "AS length" in lines._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1].split("\n")[1]
