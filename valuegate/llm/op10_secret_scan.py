"""Secret scan with DataFrame functions only: fixed patterns, and character Markov models for strings that look random.

Two first-order character models, one of random strings and one of ordinary identifiers, are trained from labelled
samples by counting character pairs. A run of key-like characters is reported when its log-likelihood ratio is high, and
else those parts of it between joint characters whose own ratio is.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegate.llm.storage import table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs below the least length never count, and nothing of the kind can begin inside one; so the length is in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What the models look at.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"[A-Za-z_]{4,}"
KINDS = ("assign", "access", "hex", "markov")
MIN_VALUE = 6
#: The characters of the models; position 0 stands for the beginning of a string.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIDE = len(ALPHABET) + 1
#: Nats by which the random model must be ahead, in all and for each character.
LEAST_TOTAL, LEAST_EACH = 12.0, 0.75
#: Characters that join parts of paths and identifiers as well as of keys: pairs with them say nothing.
JOINTS = "+/_=-"
#: Characters that a part of a run needs, as the whole run does, and nats that it may fall behind before it ends.
LEAST_PART, DROP = 20, 6.0
#: Bounds of the training samples, in documents: of strings labelled random and of ordinary identifiers.
RANDOM_DOCS, ORDINARY_DOCS = 50_000, 2_000
MASK = "<secret>"
#: Matches of a text that are handled at a time.
GROUP = 256
SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def located(text: Column, pattern: str, kind: str) -> Column:
    """The leftmost non-overlapping matches: array of (start, rank, end, kind, value), in code points, the end exclusive.

    The text is cut at its matches. They are placed in groups of ``GROUP`` and the groups then put together, so that no long
    array grows match by match.
    """
    none = F.array().cast(f"array<{SPAN}>")
    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["p"])
        end = begin + F.length(pair["m"])
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), pair["m"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def placed(cut: Column) -> Column:
        def group(acc: Column, g: Column) -> Column:
            part = F.aggregate(F.slice(cut, g * GROUP + 1, F.lit(GROUP)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return _once(part, lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], F.array(p["out"])).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
        return F.aggregate(_numbers(cut), start, group, lambda acc: F.flatten(acc["out"]))

    def cut(matches: Column) -> Column:
        # Texts without a match, nearly all, are not cut at all.
        before = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        pairs = F.zip_with(before, matches, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
        return F.when(F.size(matches) > 0, _once(pairs, placed)).otherwise(none)

    return _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), cut)


def _numbers(items: Column) -> Column:
    """The numbers of the groups of an array that is not empty."""
    return F.sequence(F.lit(0), F.floor((F.size(items) - 1) / GROUP).cast("int"))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the fixed patterns by kind: assign, access and hex."""
    spans = {kind: located(text, pattern, kind) for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))}
    spans["assign"] = F.filter(spans["assign"], lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= MIN_VALUE)
    return spans


def corpus_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", random_docs: int = RANDOM_DOCS, ordinary_docs: int = ORDINARY_DOCS) -> DataFrame:
    """Labelled samples (value, random 0/1): strings that the fixed patterns mark are random, runs of letters are ordinary.

    About ``random_docs`` and ``ordinary_docs`` documents are looked at, or all if there are fewer, chosen by a hash of id and
    text. One pass.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.count()
    share = F.abs(F.xxhash64("id", "text") % 1_000_003)
    within = lambda bound: share < math.ceil(1_000_003 * min(1.0, bound / max(total, 1)))
    rows = rows.filter(within(max(random_docs, ordinary_docs))).withColumns({"marks": within(random_docs), "words": within(ordinary_docs)})
    spans = base_spans(F.col("text"))
    values = F.concat(F.transform(spans["assign"], lambda s: F.regexp_extract(s["value"], ASSIGN, 2)), F.transform(F.concat(spans["access"], spans["hex"]), lambda s: s["value"]))
    labelled = lambda values, random: F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(random).alias("random")))
    none = F.array().cast("array<struct<value:string,random:int>>")
    both = F.concat(F.when(F.col("marks"), labelled(values, 1)).otherwise(none), F.when(F.col("words"), labelled(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 0)).otherwise(none))
    return rows.select(F.explode(both).alias("s")).select("s.*")


def _place(char: Column) -> Column:
    return F.instr(F.lit(ALPHABET), char)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all character pairs: SIDE * SIDE numbers, whatever the sample's size.

    ``samples`` has value and random (1 or 0). Each model is smoothed towards the uniform one by one character, so that with no samples
    of a kind its model is uniform; nulls and characters outside the alphabet are left out.
    """
    chars = F.filter(F.split("value", ""), lambda c: (c != "") & (_place(c) > 0))
    after = samples.filter(F.col("value").isNotNull()).select("random", chars.alias("c"))
    pairs = F.zip_with(F.concat(F.array(F.lit("")), F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0)))), F.col("c"), lambda a, b: F.when(a == "", 0).otherwise(_place(a)) * SIDE + _place(b))
    counted = after.filter(F.size("c") > 0).select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count()
    counts = {0: [0.0] * (SIDE * SIDE), 1: [0.0] * (SIDE * SIDE)}
    for r in counted.collect():  # at most 2 * SIDE * SIDE rows
        counts[r["random"]][r["pair"]] = float(r["count"])
    table: list[float] = []
    for a in range(SIDE):
        row = {k: counts[k][a * SIDE : (a + 1) * SIDE] for k in (0, 1)}
        prob = lambda k, b: (row[k][b] + 20.0 / SIDE) / (sum(row[k]) + 20.0)  # noqa: E731, B023
        table += [round(math.log(prob(1, b) / prob(0, b)), 4) if b else 0.0 for b in range(SIDE)]
    joints = [ALPHABET.index(c) + 1 for c in JOINTS]
    return [0.0 if i // SIDE in joints or i % SIDE in joints else w for i, w in enumerate(table)]


def ratio(value: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a string under the two models, in one pass over its characters."""
    weights = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folded to a constant
    start = F.struct(F.lit(0).alias("prev"), F.lit(0.0).alias("sum"))

    def step(acc: Column, char: Column) -> Column:
        at = _place(char)
        return F.struct(at.alias("prev"), (acc["sum"] + F.get(weights, acc["prev"] * SIDE + at)).alias("sum"))

    return F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), start, step, lambda acc: acc["sum"])


def parts(run: Column, model: list[float]) -> Column:
    """The parts of a run, between joint characters, that the models take for random: array of spans.

    One pass over the pieces: neighbours are put together as long as that gains, and a piece that is random by itself is
    never left out.
    """
    pieces = F.transform(F.split(run["value"], "[+/_=-]", -1), lambda p: F.struct(F.length(p).alias("n"), ratio(p, model).alias("r")))
    start = F.expr(f"named_struct('at', 0, 'start', 0, 'end', -1, 'sum', 0D, 'total', 0D, 'peak', 0D, 'best', 0D, 'out', cast(array() AS array<{SPAN}>))")

    def ended(acc: Column) -> Column:
        good = (acc["end"] - acc["start"] >= LEAST_PART) & (acc["best"] >= LEAST_TOTAL)
        value = F.substring(run["value"], acc["start"] + 1, acc["end"] - acc["start"])
        span = F.struct((run["start"] + acc["start"]).alias("start"), run["rank"].alias("rank"), (run["start"] + acc["end"]).alias("end"), run["kind"].alias("kind"), value.alias("value"))
        return F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])

    def extended(acc: Column, p: Column) -> Column:
        new = acc["sum"] <= 0
        gain = p["r"] - LEAST_EACH * p["n"]
        total = F.when(new, p["r"]).otherwise(acc["total"] + p["r"])
        return F.struct(
            acc["at"].alias("at"), F.when(new, acc["at"]).otherwise(acc["start"]).alias("start"), F.when(new, -1).otherwise(acc["end"]).alias("end"),
            F.when(new, gain).otherwise(acc["sum"] + gain - LEAST_EACH).alias("sum"), total.alias("total"), F.when(new, 0.0).otherwise(acc["peak"]).alias("peak"),
            acc["best"].alias("best"), acc["out"].alias("out"),
        )

    def grown(acc: Column, p: Column) -> Column:
        alone = (p["n"] >= LEAST_PART) & (p["r"] >= F.greatest(F.lit(LEAST_TOTAL), LEAST_EACH * p["n"]))
        more = alone | (acc["sum"] > acc["peak"])
        at = lambda name, other: F.when(more, other).otherwise(acc[name]).alias(name)
        kept = [acc[k].alias(k) for k in ("at", "start", "sum", "total", "out")]
        return F.struct(*kept, at("end", acc["at"] + p["n"]), at("peak", acc["sum"]), at("best", acc["total"]))

    def step(acc: Column, p: Column) -> Column:
        def closed(a: Column) -> Column:
            over = (a["sum"] <= 0) | (a["peak"] - a["sum"] > DROP)
            zero = lambda name, by: F.when(over, by).otherwise(a[name]).alias(name)
            return F.struct(
                (a["at"] + p["n"] + 1).alias("at"), a["start"].alias("start"), zero("end", F.lit(-1)), zero("sum", F.lit(0.0)), a["total"].alias("total"),
                zero("peak", F.lit(0.0)), a["best"].alias("best"), F.when(over, ended(a)).otherwise(a["out"]).alias("out"),
            )

        return _once(_once(extended(acc, p), lambda a: grown(a, p)), closed)

    return F.aggregate(pieces, start, step, ended)


def rewritten(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """``text`` with ``by(fresh, length)`` in place of each span; ``fresh`` is false for what goes on with a span before it.

    A text is worked on in stretches of ``GROUP`` spans, so that neither it nor the result is copied for every span.
    """

    def made(ordered: Column) -> Column:
        def group(acc: Column, g: Column) -> Column:
            part = F.slice(ordered, g * GROUP + 1, F.lit(GROUP))
            last = F.array_max(F.transform(part, lambda s: s["end"]))
            base = acc["at"]

            def within(stretch: Column) -> Column:
                def step(a: Column, s: Column) -> Column:
                    begin, end = F.greatest(a["at"], s["start"]), F.greatest(a["at"], s["end"])
                    kept = F.substring(stretch, a["at"] - base + 1, begin - a["at"])
                    return F.struct(end.alias("at"), F.concat(a["out"], kept, by(s["start"] >= a["at"], end - begin)).alias("out"))

                return F.aggregate(part, F.struct(base.alias("at"), F.lit("").alias("out")), step)

            done = _once(F.substring(text, base + 1, F.greatest(last - base, F.lit(0))), within)
            return _once(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["parts"], F.array(d["out"])).alias("parts")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
        end = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
        return F.when(F.size(ordered) > 0, F.aggregate(_numbers(ordered), start, group, end)).otherwise(text)

    return _once(F.array_sort(spans), made)


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with spaces in place of the spans, so that all else keeps its place."""
    return rewritten(text, spans, lambda fresh, length: F.repeat(F.lit(" "), length))


def redact(text: Column, spans: Column, mask: str = MASK) -> Column:
    """``text`` with every span, or union of overlapping spans, replaced by ``mask``."""
    return rewritten(text, spans, lambda fresh, length: F.when(fresh, mask).otherwise(""))


def scan(docs: DataFrame, model: list[float], text_col: str = "text", into: str = "found") -> DataFrame:
    """``docs`` with the column ``into``: a struct of the arrays assign, access, hex and markov and all of them as spans, by start and kind.

    Narrow and row by row. A null or empty text has no spans; an empty table stays empty; a column of ``docs`` that is
    named ``into`` is an error. What spans of the fixed patterns hold is not reported again; what they leave of a run is
    looked at as a run.
    """
    if into in docs.columns:
        raise ValueError(f"the table has a column {into}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = lambda s: ratio(s["value"], model) >= F.greatest(F.lit(LEAST_TOTAL), LEAST_EACH * F.length(s["value"]))

    def complete(base: Column) -> Column:
        rest = blanked(text, F.concat(base["assign"], base["access"], base["hex"]))
        runs = _once(rest, lambda t: located(t, RUN, "markov"))
        markov = F.flatten(F.transform(runs, lambda s: F.when(whole(s), F.array(s)).otherwise(parts(s, model))))
        every = lambda m: F.array_sort(F.concat(base["assign"], base["access"], base["hex"], m))
        return _once(markov, lambda m: F.struct(base["assign"].alias("assign"), base["access"].alias("access"), base["hex"].alias("hex"), m.alias("markov"), every(m).alias("spans")))

    base = F.struct(*(c.alias(kind) for kind, c in base_spans(text).items()))
    return docs.withColumn(into, _once(base, complete))


def named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = scan(docs, train(corpus_samples(docs))).select("doc_id", "found.*")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    sizes = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return scanned.select("doc_id", *sizes, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
