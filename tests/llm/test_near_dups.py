"""Near duplicates of vectors and documents, components, and the pipeline, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from valuegate.llm import op1_embedding_near_dedup as op1
from valuegate.llm import op9_minhash_near_dedup as op9
from valuegate.llm.components import components
from valuegate.llm.storage import table


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    random.seed(2)
    links = [(random.randint(0, 60), random.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 3)] + [(200, i) for i in range(201, 230)]
    sets = Sets()
    for a, b in links:
        if a is not None and a != b:
            sets.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for x in list(sets.up)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [3, 512])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(op1, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows, base = [], rng.normal(size=(12, 16))
    for i in range(120):
        v = base[i % 12] + rng.normal(size=16) * random.Random(i).choice([0, 0.05, 0.12, 0.6])
        rows.append((i, v.tolist(), i % 3 if i % 10 else None, "x"))
    rows += [(200, None, 1, "x"), (201, [0.0] * 16, 1, "x"), (202, [float("nan")] * 16, 1, "x"), (203, [1.0, None], 1, "x"), (204, [1e300] * 16, 1, "x"), (205, [1e-300] * 16, 1, "x"), (206, [], 1, "x"), (None, [1.0] * 16, 1, "x")]
    rows += [(300 + i, base[0].tolist(), 0, "x") for i in range(9)] + [(320, (2 * base[0]).tolist(), 0, "x"), (321, base[0].tolist(), 2, "x"), (322, [1.0], 1, "x"), (323, [2.0], 1, "x")]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op1.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string")).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v) / np.abs(v).max(), k) for i, v, k, _ in rows if i is not None and k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    sets, links = Sets(), Counter()
    for x, (i, v, k) in enumerate(good):
        for j, w, m in good[x + 1 :]:
            if k == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                sets.join(i, j)
                links[i] += 1
                links[j] += 1
    for i, *_ in rows:
        if i is not None:
            assert got[i] == (links[i], sets.find(i), sets.find(i) == i)
    assert op1.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (1, [0.0, 1.0], "a"), (3, [1.0, 0.0], "a"), (4, [0.0, 2.0], "a"), (4, [0.0, 2.0], "b"), (5, [0.0, 3.0], "b"), (None, [1.0, 0.0], "a")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(3)
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in op1.near_duplicates(frame).collect())
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (3, 1, 1, False), (4, 1, 1, False), (4, 1, 4, True), (5, 1, 4, False), (0, 0, None, None)], key=lambda r: (r[0], r[1], r[2] or 0))


def test_vectors_of_the_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    links, sets = Counter(), Sets()
    by = {}
    for r in rows:
        x = np.array(r["embedding"] or [], float)
        if r["label"] is not None and len(x) and np.isfinite(x).all() and x.any():
            by.setdefault((r["label"], len(x)), []).append((r["vec_id"], x / np.sqrt(x @ x)))
    for group in by.values():
        x = np.array([v for _, v in group])
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1)), strict=True):
            a, b = group[i][0], group[j][0]
            links[a] += 1
            links[b] += 1
            sets.join(a, b)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op1.query(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r["vec_id"]: (links[r["vec_id"]], sets.find(r["vec_id"]), sets.find(r["vec_id"]) == r["vec_id"]) for r in rows}


def shingles(text):
    words = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def test_signatures_are_unbiased():
    random.seed(1)
    gaps = []
    for k in range(40):
        a = [f"w{k}_{i}" for i in range(200)]
        b = list(a)
        for _ in range(random.randint(1, 12)):
            b[random.randrange(200)] = f"x{random.random()}"
        more = "again a b c d e " * random.randint(0, 9)
        pair = [" ".join(a) + f" s{k} " + more, " ".join(b) + " " + "again a b c d e " * random.randint(0, 9)]
        text, hashes, weights, _ = op9.multisets(pair)
        sig = op9.signatures(text, hashes, weights, 2, 400)
        one, two = map(shingles, pair)
        gaps.append((sig[0] == sig[1]).mean() - sum((one & two).values()) / sum((one | two).values()))
    assert abs(np.mean(gaps)) < 0.01 and np.std(gaps) < 0.04


@pytest.mark.parametrize("block", [2, 256])
def test_documents(spark, monkeypatch, block):
    monkeypatch.setattr(op9, "BLOCK_DOCS", block)
    random.seed(8)
    word = lambda: "w%d" % random.randint(0, 10**6)
    texts = [None, "", "?!", "one", "One.", "one two three", "ONE two, three"]
    for size, edits, copies in ((120, 3, 14), (40, 1, 6), (300, 9, 10), (9, 1, 5)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            new = list(base)
            for _ in range(random.randint(0, edits)):
                new[random.randrange(size)] = word()
            texts.append(" ".join(new))
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "one", "x"), (9, texts[9], "x")]
    sets, bags = Sets(), [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            union = sum((bags[i] | bags[j]).values())
            if union and sum((bags[i] & bags[j]).values()) / union >= 0.8:
                sets.join(i, j)
    got = op9.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, group_id string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["group_id"] == sets.find(3) and not r["kept"]
        else:
            assert (r["group_id"], r["kept"]) == (sets.find(r["doc_id"]), sets.find(r["doc_id"]) == r["doc_id"])
    assert op9.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents_that_share_an_id_or_have_none(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, "one two three"), (1, long), (2, long + " more"), (2, "Something else"), (None, long), (None, "nobody's text"), (None, "Nobody's  text!"), (None, None), (3, None), (3, "ONE, two three")]
    got = [(r["doc_id"], r["group_id"], r["kept"]) for r in op9.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()]
    want = [(1, 1, True), (1, 1, True), (2, 1, False), (2, 2, True), (None, 1, False), (None, None, True), (None, None, False), (None, None, True), (3, 3, True), (3, 1, False)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_near_pair_of_the_given_documents_is_lost(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    number, doc, name, count = {}, [], [], []
    for k, r in enumerate(rows):
        for s, n in shingles(r["text"]).items():
            doc.append(k)
            name.append(number.setdefault(s, len(number)))
            count.append(n)
    doc, name, count = map(np.array, (doc, name, count))
    total, bounds = np.bincount(doc, weights=count, minlength=len(rows)), np.searchsorted(doc, np.arange(len(rows) + 1))
    have, pairs, sets = np.zeros(len(number)), 0, Sets()
    for k in range(len(rows)):
        mine = slice(bounds[k], bounds[k + 1])
        have[name[mine]] = count[mine]
        common = np.bincount(doc, weights=np.minimum(have[name], count), minlength=len(rows))
        have[name[mine]] = 0
        for other in np.flatnonzero((common / np.maximum(total + total[k] - common, 1) >= 0.8) & (np.arange(len(rows)) < k)):
            sets.join(rows[k]["doc_id"], rows[other]["doc_id"])
            pairs += 1
    assert pairs > 50
    assert {r["doc_id"]: r["group_id"] for r in op9.query(spark, folder).collect()} == {r["doc_id"]: sets.find(r["doc_id"]) for r in rows}


def test_pipeline_keeps_columns_and_clean_documents(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, sf_dir, "documents")
    names, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == names, name
        assert 0.75 * count <= docs.count() <= count, name
        count = docs.count()
    texts = {r["text"] for r in docs.collect()}
    assert len(texts) == count
    assert not any(re.search(r"AKIA[A-Z0-9]{16}|password=\w{6}", t or "") for t in texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == count
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, sf_dir).cache()
        assert odd.select("doc_id").distinct().count() == 3, name


def test_pipeline_over_odd_rows(spark, sf_dir, tmp_path):
    """The whole run, with names that the operators use, ids that are shared or missing, and repeated rows."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, item = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    clash = {c: F.lit(f"own {c}") for c in ("key", "row", "found", "hex", "spans", "id", "group_id", "kept", "order", "score", "item_id")}
    clean = "A quiet morning in the harbour, and the boats came back with nothing but ropes and old nets again."
    other = "Nobody had told the gardener that the gate would be painted green before the first of the guests arrived."
    rows = [(None, "see " + item), (None, clean), (10**6, other), (10**6, "It rained on the hills for nine days and every mill along the river ran again as it once had."), (10**6, other), (10**6 + 1, "the key is password=hunter2secret and no more of it stays in this line of text")]
    added = spark.createDataFrame([(i, t, "en", "odd", len(t)) for i, t in rows], docs.schema)
    docs.unionByName(added).withColumns(clash).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        table(spark, sf_dir, name).write.parquet(f"{tmp_path}/{name}.parquet")
    folder = f"file://{tmp_path}"
    packed = corpus_pipeline.run(spark, folder)
    assert packed.filter("doc_id is null").select("start").distinct().count() == 1
    assert packed.filter("doc_id = 1000000 and start = 0").count() == 2
    stage = table(spark, folder, "documents")
    for name, step in corpus_pipeline.STAGES[:-1]:
        stage = step(spark, stage, folder).cache()
        assert stage.columns == table(spark, folder, "documents").columns, name
    kept = stage.filter("source = 'odd'").collect()
    assert sorted(r["text"][:12] for r in kept) == sorted([clean[:12], other[:12], "It rained on", "the key is <"])
    assert all(r[c] == f"own {c}" for r in kept for c in clash)
    masked = next(r for r in kept if r["doc_id"] == 10**6 + 1)
    assert "hunter2secret" not in masked["text"] and masked["n_chars"] == len(masked["text"])
    empty = table(spark, folder, "documents").limit(0)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, empty, folder).count() == 0, name


def test_components_take_no_round_for_what_is_settled(spark, monkeypatch):
    """Stars are not gone over again, nor are few links more than they need; no step sends rows to the driver."""
    from valuegate.llm import components as cc

    steps, step = [], cc._step
    monkeypatch.setattr(cc, "_step", lambda links: steps.append(step(links)) or steps[-1])
    ends = cc.stars(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)], "a long, b long"))
    assert steps and not any("Broadcast" in s._jdf.queryExecution().executedPlan().toString() for s in steps)
    steps.clear()
    assert components(ends).count() == 71 and not steps
    got = {r["node"]: r["component"] for r in components(ends.unionAll(spark.createDataFrame([(7, 110)], "a long, b long"))).collect()}
    assert set(got.values()) == {0} and len(got) == 71 and len(steps) <= 2
