"""Hot keys are dealt out, shared windows do not multiply, and registered queries agree with plain versions over the given tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests_llm_helpers import windows_removed
from valuegate.llm import components as cc
from valuegate.llm import op3_decontamination, op4_bit_packing, op7_substring_dedup, op8_warc_derivatives, op10_secret_scan
from valuegate.llm.storage import written

SKEW = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.files.maxPartitionBytes": "256k",
}


@pytest.fixture
def skewed(spark):
    before = {k: spark.conf.get(k, None) for k in SKEW if k != "spark.sql.adaptive.autoBroadcastJoinThreshold"}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield
    for k in SKEW:
        if before.get(k) is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, before[k])


def tasks(rows):
    """Rows of each task of the last join; every column is read, so all of them are shuffled."""
    return sorted(r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), *(F.max(c) for c in rows.columns)).collect())


def test_a_hubs_links_are_dealt_out(spark, skewed):
    """A star of 400,000 links beside a chain: no task of the join gets more than three times the median."""
    star = spark.range(1, 400_001, numPartitions=8).select((F.col("id") + 1_000_000).alias("a"), F.lit(1_000_000).cast("long").alias("b"))
    chain = spark.range(40_000, numPartitions=8).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    links = written(star.unionAll(chain), "star")
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = tasks(cc.each_with(both, cc._star(both), "a"))
    assert sum(sizes) == 880_000 and sizes[-1] <= 3 * sizes[len(sizes) // 2], sizes
    # A component of all nodes, named by its least member.
    found = written(star.select(F.col("a").alias("node"), F.col("b").alias("component")), "found")
    names = found.groupBy("component").agg(F.min("node").alias("least"))
    sizes = tasks(cc.each_with(found, names, "component"))
    assert sum(sizes) == 400_000 and sizes[-1] <= 3 * sizes[len(sizes) // 2], sizes


def test_a_preamble_of_all_items_does_not_multiply(spark):
    """Items under one instruction: documents that share it meet a row a window, whatever the number of items; questions of their own still match."""
    random.seed(12)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(7))
    preamble = "please read the following passage with care and then answer each question below in one word"
    items = [(k, f"{preamble} {' '.join(word() for _ in range(20))}") for k in range(1000)]
    texts = [(k, f"{word()} {preamble} {' '.join(word() for _ in range(8))}", "x") for k in range(300)]
    texts += [(1000 + k, f"{word()} {items[k][1]} {word()}", "x") for k in range(20)] + [(2000, "nothing of the kind here at all but plain words that go on and on", "x")]
    docs, benchmark = spark.createDataFrame(texts, "doc_id long, text string, n_items string"), spark.createDataFrame(items, "item_id long, text string")
    rows = op3_decontamination.contaminated(docs, benchmark).collect()
    assert len(rows) <= 3 * len(texts)
    shared = {r["doc_id"]: r for r in rows if r["n_items"] > 1}
    assert set(shared) == {t[0] for t in texts} - {2000} and {r["n_items"] for r in shared.values()} == {1000}
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["n_items"] == 1} >= {(1000 + k, k) for k in range(1, 20)}
    one = shared[0]
    listed = op3_decontamination.members(benchmark).filter((F.col("hash") == one["hash"]) & (F.col("class") == one["class"])).groupBy("cased").count().collect()
    assert 1000 in {r["count"] for r in listed}


def test_slots_of_shared_templates_must_be_consistent(spark):
    """A template of which many items are instances: a document with equal values where they have equal values matches, another does not."""
    form = "if {a} apples and {b} pears and {c} plums are shared out among friends how many fruits are there for every friend"
    items = [(k, form.format(a=k, b=k + 500, c=k)) for k in range(1, 60)]
    texts = [(1, form.format(a=7000, b=8000, c=7000), "x"), (2, form.format(a=7000, b=8000, c=9000), "x"), (3, form.format(a=7000, b=7000, c=7000), "x")]
    docs, benchmark = spark.createDataFrame(texts, "doc_id long, text string, class string"), spark.createDataFrame(items, "item_id long, text string")
    rows = op3_decontamination.contaminated(docs, benchmark).collect()
    assert {r["doc_id"] for r in rows} >= {1} and len(rows) < 10
    whole = {r["doc_id"] for r in rows if r["matched"] >= 20}
    assert whole == {1}


def test_many_documents_are_read_at_once(spark, tmp_path):
    import public_tokenizers

    docs = spark.createDataFrame([(3 * k, f"text {k}") for k in range(4000)], "doc_id long, text string")
    op4_bit_packing.write_ids(docs, f"file://{tmp_path}/ids", public_tokenizers.path("word_bpe_49k.json"))
    wanted = [k for k in range(12_000) if k % 2 == 0]
    read = lambda ids: sorted(r["doc_id"] for r in op4_bit_packing.read_documents(spark, f"file://{tmp_path}/ids", ids).select("doc_id").collect())
    assert read(wanted) == [k for k in wanted if k % 3 == 0]
    assert read([]) == [] and read([10**12, -5]) == [] and read([6, 6, 11_997]) == [6, 11_997]


def test_the_secret_query_matches_its_patterns(spark, sf_dir):
    rules = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op10_secret_scan.query(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(rules) for m in re.finditer(p, texts[r["doc_id"]]) if ok(m)]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in found) for n in range(3)]
        named = [f"{rules[k][0]}:{a}:{b}" for a, k, b in sorted(found)]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("markov:")] == named
        order = [(int(s.split(":")[1]), ["assign", "access", "hex", "markov"].index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)


def test_the_passage_query_matches_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op7_substring_dedup.query(spark, sf_dir).collect()}
    assert got == windows_removed(texts, 35)


def test_passages_of_very_long_texts(spark):
    random.seed(5)
    word = lambda: "w%d" % random.randint(0, 10**7)
    common = [word() for _ in range(80)]
    texts = {0: " ".join([word() for _ in range(200_000)] + common + [word() for _ in range(100_000)]), 1: " ".join(common[:50]), 2: " ".join([word() for _ in range(20)])}
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op7_substring_dedup.remove_repeats(docs).collect()}
    assert got == windows_removed(texts, 35)


def test_warc_records_of_odd_tables(spark):
    kinds = "page_id long, url string, html string, block string, warc_type string"
    empty = spark.createDataFrame([], kinds)
    assert op8_warc_derivatives.derivatives(empty).count() == 0
    rows = [(1, "u", "<p>a</p>", "own", "own"), (1, "u", "<p>a</p>", "own", "own"), (None, None, None, None, None), (2, "u", "<p>b</p>" * 200_000, "own", "own")]
    made = op8_warc_derivatives.derivatives(spark.createDataFrame(rows, kinds)).collect()
    assert len(made) == 12 and not any(r["block"] == "own" or r["warc_type"] == "own" for r in made)
    assert len({r["record_id"] for r in made if r["page_id"] == 1}) == 3 and len([r for r in made if r["page_id"] == 1]) == 6
    assert [r["content_length"] for r in made if r["page_id"] is None and r["warc_type"] != "metadata"] == [0, 0]
    assert next(r["block"] for r in made if r["page_id"] == 2 and r["warc_type"] == "conversion") == "\n".join("b" * 200_000)
