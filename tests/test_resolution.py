"""The resolution chain against brute force: search, entity resolution, missed values, understanding and worked examples."""

import random
import re
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from valuegate.functions import similarity as sim
from valuegate.operators import resolve, search
from valuegate.plans.registry import QUERIES

GENERIC = ["the", "of", "and", "per"]
INDEX = [
    ("aspirin", "med.name"), ("aspirin 81 mg", "med.name"), ("ASPIRIN EC", "med.brand"), ("ibuprofen", "med.name"), ("acetaminophen", "med.name"), ("hepatitis", "diag.text"),
    ("cardiovascular|chest pain|acute coronary syndrome", "diag.text"), ("pulmonary|respiratory failure|acute", "diag.text"), ("neuro icu", "unit.type"), ("med-surg icu", "unit.type"),
    ("other hospital", "unit.source"), ("testes", "lab.site"), ("hemoglobin", "lab.name"), ("glucose", "lab.name"), ("female", "patient.gender"), ("male", "patient.gender"), ("Café au lait", "diag.note"),
]
TIER_B = [("warfarin sodium", "order.text"), ("warfarin", "order.text"), ("xylocaine jelly", "order.text"), ("glucosamine", "order.other")]
SCOPE = [("drug", "med.name", 0), ("drug", "med.brand", 1), ("place", "unit.type", 0), ("test", "lab.name", 0), ("order", "order.text", 0)]
CARDS = [("med.name", "med", "name", ["drug name"]), ("unit.type", "unit", "type", ["unit"]), ("lab.name", "lab", "name", ["lab test"]), ("patient.gender", "patient", "gender", ["sex"])]


def tokens(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return {t for t in re.findall("[a-z0-9]+", plain) if len(t) > 1}


def parts(value):
    cut = [p for p in re.split(r"\s*[|/;:]\s*", value) if len(p.strip()) > 3]
    return [value, *cut[:6]] if len(value) > 32 and len(cut) > 1 else [value]


def near(mention, value):
    return round(sim.similarity(mention, value, parts(value)), 4)


def within(mention, index, tier_b):
    """The cascade over the given values: all tokens, some tokens, on demand, misspellings."""
    asked = tokens(mention)
    hits = [(v, r, near(mention, v), {t for t in asked if any(w.startswith(t) for w in tokens(v))}) for v, r in index]
    hits = [h for h in hits if h[3] and h[2] >= 0.55]
    for chosen in ([h for h in hits if h[3] == asked], hits):
        if chosen:
            return [h[:3] for h in chosen]
    found = [(v, r, near(mention, v)) for v, r in tier_b if mention.lower().strip() in v.lower()]
    found = [h for h in found if h[2] >= 0.55]
    if not found:
        found = [(v, r, round(sim.ratio(mention.lower(), v.lower()), 4)) for v, r in index]
        found = sorted((h for h in found if h[2] >= 0.8), key=lambda h: (-h[2], h[0], h[1]))[:20]
    return found


def looked_up(mention, columns):
    """(value, ref, score) by rank, one a column; and whether they come from outside the columns."""
    inside = lambda rows: [x for x in rows if x[1] in columns]
    found = within(mention, inside(INDEX), inside(TIER_B)) if columns else []
    outside = bool(columns) and not found
    found = found or within(mention, INDEX, TIER_B)
    rank = {c: i for i, c in enumerate(columns)}
    best = {}
    for v, r, s in sorted(found, key=lambda h: (-h[2], rank.get(h[1], 1 << 20), len(h[0]), h[0], h[1])):
        best.setdefault(r, (v, r, s))
    return list(best.values()), outside


def spans(mention):
    words = mention.split()
    out = [" ".join(words[a : a + n]) for n in range(len(words) - 1, 0, -1) for a in range(len(words) - n + 1)]
    out = [s for s in dict.fromkeys(out) if not all(w.lower().strip(".,;:()") in GENERIC for w in s.split())]
    return out[:6]


def resolved(mention, type_, links):
    columns = [c for t, c, _ in SCOPE if t == type_]
    (found, outside), used = looked_up(mention, columns), mention
    score = found[0][2] if found else 0.0
    if score < 0.75:
        for span in spans(mention):
            other, out = looked_up(span, columns)
            if other and other[0][2] > score:
                found, outside, used, score = other, out, span, other[0][2]
                if score >= 0.99:
                    break
    if not found:
        column = links.get(mention, (None, 0))[0]
        return ("concept" if column else "value", None, column, 0.0, mention, [], False)
    value, ref, score = found[0]
    exact = value.strip().lower() == used.strip().lower()
    outside = outside and not exact
    score = round(score * (0.7 if outside else 1.0), 4)
    column, link = links.get(used, (None, 0))
    if column and not exact and link >= score:
        return ("concept", None, column, 0.0, used, [f"{ref} = {value} ({score:.2f}, not used)"], False)
    return ("value", value, ref, score, used, [f"{r} = {v}" for v, r, _ in found[1:4]], outside)


@pytest.fixture(scope="module")
def frames(spark):
    make = lambda rows, kind: spark.createDataFrame(rows, kind).cache()
    return {
        "index": make(INDEX, "value string, ref string"), "tier_b": make(TIER_B, "value string, ref string"), "scope": make(SCOPE, "type string, ref string, position int"),
        "cards": make(CARDS, "ref string, table_name string, column_name string, synonyms array<string>"), "heads": make([("name",), ("type",)], "word string"),
    }


MENTIONS = ["aspirin", "asprin", "ASPIRIN", "hemoglobin lab test", "chest pain", "neuro icu", "icu", "warfarin", "xylocaine", "glucos", "the warfarin of x", "zzqqx", "acetaminofen", "ibu", "cafe", "respiratory failure of the lung", "drug name", "Other Hospital", "female", "lab test", "81", "", "a"]


def test_value_search_is_the_cascade(spark, frames):
    got = {}
    for r in search.value_search(spark.createDataFrame([(m,) for m in MENTIONS], "mention string"), frames["index"], frames["tier_b"]).collect():
        got.setdefault(r["mention"], []).append((r["place"], (r["value"], r["ref"], r["score"])))
    want = {m: looked_up(m, [])[0][:5] for m in MENTIONS if m}
    assert {m: [x for _, x in sorted(v)] for m, v in got.items() if m} == {m: v for m, v in want.items() if v}


def test_resolution(spark, frames):
    types = ["drug", "place", "test", "order", "none"]
    entities = [(i, 0, m, t, "value") for i, (m, t) in enumerate((m, t) for m in MENTIONS if m for t in types)] + [(9000, 1, "unit", "place", "concept"), (9001, 1, "7", "x", "quantity"), (9002, 0, "Mr X", "person", "person")]
    rows = spark.createDataFrame(entities, "id long, place int, mention string, type string, kind string")
    generic = F.array(*map(F.lit, GENERIC))
    got = resolve.resolve(rows, frames["index"], frames["cards"], frames["heads"], frames["scope"], generic, frames["tier_b"]).collect()
    assert len(got) == len(entities)
    asked = {s for _, _, m, _, _ in entities for s in [m, *spans(m)]}
    links = {r["mention"]: (r["ref"], r["score"]) for r in search.link_columns(spark.createDataFrame([(m,) for m in asked], "mention string"), frames["cards"], frames["heads"], 1).collect()}
    for r in got:
        if r["id"] < 9000:
            assert (r["kind"], r["value"], r["column"], r["score"], r["used"], r["alternatives"], r["out_of_scope"]) == resolved(r["mention"], r["type"], links), (r["mention"], r["type"])
    rest = {r["id"]: (r["kind"], r["value"], r["column"]) for r in got if r["id"] >= 9000}
    assert rest == {9000: ("concept", None, "unit.type"), 9001: ("quantity", None, None), 9002: ("person", None, None)}


def test_missed_values_and_understanding(spark, frames):
    texts = spark.createDataFrame([(1, "Aspirin 81 mg or ibuprofen for 3 females with hepatitis"), (2, "nothing"), (3, None)], "id long, text string")
    kind = "id long, mention string, used string, kind string, value string, column string, score double"
    found = spark.createDataFrame([(1, "Aspirin 81 mg", "Aspirin 81 mg", "value", "aspirin 81 mg", "med.name", 1.0), (1, "hepatitis", "hepatitis", "concept", None, "diag.text", 0.0), (1, "fem", "fem", "value", "female", "patient.gender", 0.6)], kind)
    known = spark.createDataFrame([(1, "aspirin"), (1, "aspirin 81 mg"), (1, "ibuprofen"), (1, "hepatitis"), (1, "female")], "id long, value string")
    missed = resolve.missed_values(known, found, frames["index"])
    assert {(r["id"], r["mention"], r["value"], r["column"]) for r in missed.collect()} == {(1, "ibuprofen", "ibuprofen", "med.name"), (1, "female", "female", "patient.gender")}
    scope = spark.createDataFrame([(1, ["unit.type"], ["unit"], ["a note"])], "id long, columns array<string>, tables array<string>, notes array<string>")
    rows = {r["id"]: r for r in resolve.understand(texts, found, missed, scope).collect()}
    assert rows[1]["values"] == ["med.name = aspirin 81 mg", "med.name = ibuprofen", "patient.gender = female"] and rows[1]["concepts"] == ["diag.text"]
    assert rows[1]["numbers"] == ["3"] and rows[1]["tables"] == ["diag", "med", "patient", "unit"] and rows[1]["notes"] == ["a note"]
    assert all(rows[i]["values"] == rows[i]["tables"] == rows[i]["numbers"] == [] for i in (2, 3))


def test_nearest_examples(spark):
    random.seed(4)
    words = ["How", "many", "parts", "of", "size", "ring", "blue", "List", "customers", "in"]
    made = lambda: " ".join(random.choice(words) for _ in range(random.randint(1, 6)))
    texts, examples = [(i, made()) for i in range(40)], sorted({made() for _ in range(60)})
    leaked = examples[::7]
    got = {}
    for r in search.nearest_examples(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(e,) for e in examples], "example string"), spark.createDataFrame([(e,) for e in leaked], "example string")).collect():
        got.setdefault(r["id"], []).append((-r["score"], r["example"]))
    for i, text in texts:
        usable = [e for e in examples if e not in leaked and e.lower() != text.lower() and set(e.split()) & set(text.split())]
        assert sorted(got.get(i, [])) == sorted((-round(sim.token_set(text, e), 4), e) for e in usable)[:3]


def test_nearest_examples_in_several_units(spark, monkeypatch):
    monkeypatch.setattr(search, "EXAMPLES", 7)
    monkeypatch.setattr(search, "TEXTS", 11)
    test_nearest_examples(spark)


def test_fuzzy_search(spark):
    random.seed(8)
    made = lambda: "".join(random.choice("aab0 é") for _ in range(random.randint(0, 12)))
    index = [(made(), random.choice(["x.a", "x.b"])) for _ in range(300)] + [("Customer#%09d" % i, "x.c") for i in range(40)] + [(None, "x.a"), ("aab" * 40, "x.a")]
    mentions = [made() for _ in range(60)] + ["customer#000000017", "Custmer#00000001", "aab" * 39, "", None]
    got = {}
    for r in search.search_fuzzy(spark.createDataFrame([(m,) for m in mentions], "mention string"), spark.createDataFrame(index, "value string, ref string")).collect():
        got.setdefault(r["mention"], set()).add((-r["score"], r["value"], r["ref"]))
    for m in set(filter(None, mentions)):
        near = sorted((-round(sim.ratio(m.lower(), v.lower()), 4), v, r) for v, r in set(index) if v)
        assert got.pop(m, set()) == set([h for h in near if h[0] <= -0.8][:20]), m
    assert not got


def test_layout_by_a_join_key(spark, sf_dir):
    plan = QUERIES["join_key_layout"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "hashpartitioning(o_orderkey" not in plan and "hashpartitioning(l_orderkey" not in plan


def test_fingerprints_carry(spark):
    from valuegate.operators import evaluate

    values = [0.99999999999, 1.0, 9.99999999999e9, 1e10, 0.1 + 0.2, 0.3, 123456789.4, 1e15, 1e-7, 0.99999999949, 999999999.5, 99999999.95, -0.99999999999, 1e300, 5e-324]
    kind = spark.createDataFrame([(v,) for v in values], "x double")
    cells = [r[0] for r in evaluate.cells(kind).collect()]
    nine = lambda v: "%.9g" % v
    usual = [(v, c) for v, c in zip(values, cells, strict=True) if 1e-290 < abs(v) < 1e290]
    for v, c in usual:
        for w, d in usual:
            assert (c == d) == (nine(v) == nine(w)), (v, w, c, d)


def test_examples_are_visited_by_their_bound(monkeypatch):
    """The same best three as by scoring every example, with far fewer scored."""
    rng = random.Random(31)
    words = "how many orders of customers in each region with priority high low total price per month and year by segment status part name size brand".split()
    made = lambda n: " ".join(rng.choice(words) for _ in range(n))
    examples = sorted({made(rng.randint(3, 12)) for _ in range(400)} | {"none of it", "", "x"})
    texts = [(k, made(rng.randint(1, 12))) for k in range(40)] + [(k + 100, f"{rng.choice(examples)} {rng.choice(words)}") for k in range(40)] + [(900, ""), (901, examples[7])]
    low = lambda t: " ".join(t.split()).lower()
    want = {(k, e, -s) for k, t in texts for s, e in sorted((-round(sim.token_set(t, e), 4), e) for e in examples if set(t.split()) & set(e.split()) and low(e) != low(t))[:3]}
    calls, whole = [], sim.token_set
    monkeypatch.setattr(search.sim, "token_set", lambda a, b: calls.append(1) or whole(a, b))
    got = search._nearest(3)(pd.DataFrame(texts, columns=["id", "text"]), pd.DataFrame({"example": examples}))
    assert {tuple(r) for r in got.itertuples(index=False)} == want
    met = sum(bool(set(t.split()) & set(e.split())) for _, t in texts for e in examples)
    assert len(calls) < 0.4 * met
