"""Golden cases of operators that SQL cannot check, and properties."""

import random
import unicodedata

from pyspark.sql import functions as F

from valuegate.functions import similarity as sim
from valuegate.functions import text as tx
from valuegate.operators import evaluate as ev
from valuegate.operators import gate, journal, masking, search, tagging


def test_ratio_by_hand():
    assert sim.ratio("kitten", "sitting") == 8 / 13
    assert sim.ratio("", "") == 1.0 and sim.ratio("a", "") == 0.0
    assert sim.best_part("ring", "small ring") == 1.0
    assert sim.token_set("new york mets", "mets york new jersey") == 1.0
    assert sim.token_set("", "a") == 0.0


def test_common_matches_dynamic_program():
    random.seed(5)
    for _ in range(200):
        a, b = ("".join(random.choice("abc") for _ in range(random.randint(0, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert sim.common(a, b) == row[-1]


def test_tagging_takes_longer_triggers_first(spark):
    terms = spark.createDataFrame([("stay", ["length of stay"], ["a.b"], "n"), ("length", [], ["a.c"], None)], "term string, synonyms array<string>, columns array<string>, note string")
    texts = spark.createDataFrame([(1, "Length of stay, and stay or length"), (2, None), (3, "")], "id long, text string")
    rows = {r["id"]: [(t["position"], t["term"]) for t in r["tags"]] for r in tagging.tag(texts, terms).collect()}
    assert rows == {1: [(0, "stay"), (6, "length")]}


def test_spans_keep_the_longest(spark):
    rows = [(1, "a", "new york", 0.5, 0, 8), (1, "b", "york", 0.9, 4, 8), (1, "b", "York", 0.9, 20, 24), (1, "c", "york", 0.9, -1, -1)]
    df = spark.createDataFrame(rows, "id long, type string, entity string, score double, start int, end int")
    spans = tagging.dedup_spans(df).first()["spans"]
    assert [(s["entity"], s["start"]) for s in spans] == [("new york", 0), ("York", 20)]


def test_mask_and_unmask_are_inverse(spark):
    texts = spark.createDataFrame([(1, "ship aspirin 81 mg or aspirin"), (2, "nothing here")], "id long, text string")
    found = spark.createDataFrame([(1, 0, "aspirin", "aspirin", "t.c"), (1, 1, "aspirin 81 mg", "aspirin 81 mg", "t.c")], "id long, place int, mention string, value string, ref string")
    numbered = masking.number_symbols(found)
    masked = masking.mask(texts, numbered)
    assert {r["id"]: r["masked"] for r in masked.collect()} == {1: "ship :v1 or :v2", 2: "nothing here"}
    vault = masking.vault(numbered, masking.spellings(numbered, spark.createDataFrame([("aspirin x", "t.c"), ("Aspirin y", "t.c")], "value string, ref string")))
    assert {r["symbol"]: r["pattern"] for r in vault.collect()} == {":v1": None, ":v2": "%aspirin%"}
    assert {r["id"]: r["text"] for r in masking.unmask(masked, vault.withColumn("symbol", F.col("symbol"))).collect()}[2] == "nothing here"


def test_substitute_keeps_c1_out_of_c10(spark):
    df = spark.createDataFrame([("c1, c10 and ac1 $1",)], "text string")
    pairs = F.array(*(F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in (("c1", "one$"), ("c10", "ten"))))
    assert df.select(tx.substitute(F.col("text"), pairs)).first()[0] == "one$, ten and ac1 $1"


def test_gate_blocks_every_informing_value(spark):
    values = spark.createDataFrame([("small ring",), ("building",), ("12",), ("x y z",)], "value string")
    texts = spark.createDataFrame([(i, f"please send {v} now") for i, v in enumerate(["Small  Ring", "BUILDING", "12", "x y z", "order"])] + [(9, None)], "id long, text string")
    listed = lambda v: gate.denylist(gate.denied_values(v, spark.createDataFrame([("order",)], "word string")), spark.createDataFrame([], "token string"))
    hits = {(r["id"], r["value"]) for r in gate.known_values(texts, listed(values)).collect()}
    assert hits == {(0, "small ring"), (1, "building"), (3, "x y z")}
    assert gate.known_values(texts, listed(values.limit(0))).count() == 0


def test_fingerprint_ignores_order_not_duplicates(spark):
    rows = [(1, 5.0, "a"), (2, 1 / 3, None), (2, 1 / 3, None)]
    kind = "k int, x double, s string"
    of = lambda r: ev.fingerprint(spark.createDataFrame(r, kind)).first()["result_hash"]
    assert of(rows) == of(rows[::-1]) != of(rows[:2])
    assert of([]) == "empty"
    assert of([(1, 0.1 + 0.2, "a")]) == of([(1, 0.3, "a")])
    assert ev.fingerprint(spark.createDataFrame([(5.0,)], "x double")).first()[0] == ev.fingerprint(spark.createDataFrame([(5,)], "x int")).first()[0]


def test_a_tie_is_no_consensus(spark):
    rows = [("q1", "a", True), ("q1", "a", True), ("q1", "b", True), ("q1", "b", True), ("q2", "a", True), ("q2", "a", True), ("q3", "a", True), ("q3", "empty", True), ("q3", "empty", True)]
    df = spark.createDataFrame(rows, "question string, result_hash string, success boolean")
    assert [tuple(r) for r in ev.consensus(df).collect()] == [("q2", "a")]


def test_calibration_prefers_the_least_cut(spark):
    rows = [(1.0, True), (1.5, True), (2.0, False), (None, True), (3.0, None)]
    best = ev.calibrate(spark.createDataFrame(rows, "perplexity double, correct boolean")).first()
    assert best["threshold"] == 1.5 and best["separates"] == 1.0 and best["samples"] == 3


def test_fuzzy_bounds_lose_nothing(spark):
    random.seed(2)
    words = ["".join(random.choice("abcd") for _ in range(random.randint(1, 9))) for _ in range(60)]
    asked = ["".join(random.choice("abcd") for _ in range(random.randint(1, 9))) for _ in range(20)]
    found = search.search_fuzzy(spark.createDataFrame([(m,) for m in asked], "mention string"), spark.createDataFrame([(w, "t.c") for w in words], "value string, ref string"), most=1000)
    want = {(m, w) for m in asked for w in words if sim.ratio(m, w) >= 0.8}
    assert {(r["mention"], r["value"]) for r in found.collect()} == want


def test_journal_skips_bad_lines(spark):
    lines = spark.createDataFrame([('{"timestamp":"2024-01-01T00:00:00Z","context":"a","allowed":true,"length":3}',), ("",), ("{bad",), ('{"context":"b","allowed":false,"length":9,"bypassed":true}',)], "value string")
    report = journal.report(journal.parsed(lines)).first()
    assert (report["sends"], report["blocked"], report["bypassed"], report["characters_sent"], report["block_rate"]) == (2, 1, 1, 3, 0.5)
    assert journal.report(journal.parsed(lines.limit(0))).first()["block_rate"] == 0.0


def test_replies(spark):
    df = spark.createDataFrame([("<think>x</think>```sql\nSELECT 1;\n```",), ("no",), (None,), ("With a as (select 1) select * from a ;",)], "r string")
    assert [x[0] for x in df.select(tx.extract_sql(F.col("r"))).collect()] == ["SELECT 1", "", "", "With a as (select 1) select * from a"]


def test_figures_are_those_of_the_true_value(spark):
    """Two doubles read the same just when nine figures of their true values, halves to even, do."""
    rng = random.Random(7)
    values = [123456788.5, 123456789.5, 123456788.0, 123456789.0, 0.1234567885, 0.1234567895, 1.234567885, 12345.67885, 1234567885.0, 12345678850.0, 999999999.5, 99999999.95, 9.999999995, 1e22, 1e23, 1e-300, 1e300, 5e-324, 0.5, -123456788.5, 8.5, 1e8, 1e9]
    values += [m / 10**k for m in (1234567885, 2000000005, 9999999995, 1000000005) for k in range(0, 20)] + [(2 * rng.randint(10**8, 10**9) + 1) / 2 for _ in range(300)]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12) for _ in range(1500)] + [rng.randint(1, 10**10) / 10 ** rng.randint(0, 12) for _ in range(1500)]
    values += [v * (1 + s * 2.0**-52) for v in values[:80] for s in (1, -1)]
    shown = [r[0] for r in ev.cells(spark.createDataFrame([(v,) for v in values], "x double")).collect()]
    ours, theirs = {}, {}
    for value, text in zip(values, shown, strict=True):
        figures = f"{value:.9g}"
        assert ours.setdefault(text, figures) == figures and theirs.setdefault(figures, text) == text, (value, text)
    odd = [r[0] for r in ev.cells(spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (0.0,), (-0.0,), (None,)], "x double")).collect()]
    assert len(set(odd)) == 5 and odd[3] == odd[4] == "0" and odd[5] == ""


def test_folding_is_unicodes(spark):
    """Every character but Korean syllables, alone, composed and decomposed, in words of several scripts."""
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
    one = [chr(k) for k in (*range(1, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x30000)) if unicodedata.category(chr(k)) not in ("Cn", "Co")]
    one = [c for c in one if len(c.lower()) == 1 and not unicodedata.normalize("NFKD", c.lower()).startswith("\x00")]
    texts = ["Crème Brûlée ﬁn", "ΆΈΉ ϋ", "Ёлка й", "Việt Nam", "éä", "①½ ㎏ ﷺ", "が ガ ｶﾞ", "", "plain", "ａｂｃ"] + ["".join(one[k : k + 50]) for k in range(0, len(one), 50)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", tx.normalize(F.col("t")).alias("n")).collect()
    wrong = [(t, r["n"], fold(t)) for r in got if r["n"] != fold(t := texts[r["id"]])]
    # Java and Python may know different versions of Unicode and lower a final sigma differently.
    assert len(wrong) <= 3, wrong[:5]
    assert spark.range(1).select(tx.normalize(F.lit(None).cast("string"))).first()[0] is None
