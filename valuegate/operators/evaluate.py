"""Evaluation of runs of text-to-SQL systems: fingerprints, references, votes, summaries, ranking and thresholds.

``results`` frames have a row for each run: question, variant, success, result_hash, and what a summary needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuegate.operators.ranks import medians, same

#: The stages that refuse.
REFUSING = ("mask", "gate")
#: A perplexity that is missing counts as this in a vote.
UNSURE = 9.9
#: The least votes that make a consensus.
VOTES = 2
#: Perplexity above which an answer is not taken without a better model's.
ESCALATE_ABOVE = 1.8


def _apart(x: Column) -> tuple[Column, Column]:
    """A double as the sum of two of 26 bits, whose products are exact."""
    wide = x * 134217729.0
    high = wide - (wide - x)
    return high, x - high


def _excess(a: Column, b: Column, product: Column) -> Column:
    """By how much the true product exceeds the rounded one, exactly."""
    (ah, al), (bh, bl) = _apart(a), _apart(b)
    return ((ah * bh - product) + ah * bl + al * bh) + al * bl


def cells(result: DataFrame) -> DataFrame:
    """Every value of ``result`` as text, so that equal answers read the same, in columns c0, c1 and so on.

    Null is empty, floats have nine figures, whole floats of up to nine read as whole numbers. The last figure is that of the
    double's true value, halves to the even one. Each step is a column of its own, made once.
    """
    plain = result.toDF(*(f"c{i}" for i in range(len(result.columns))))
    floats = [f.name for f in plain.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)]
    ten = lambda e: F.pow(F.lit(10.0), e)
    at = lambda c, what: F.col(f"{c}_{what}")
    size = lambda c: at(c, "size")

    def scaled(c: str, e: Column) -> Column:
        half = F.floor(e / 2)  # powers beyond a double's range are taken in two steps
        return F.when(F.abs(e) > 290, size(c) / ten(half) / ten(e - 8 - half)).when(e < 8, size(c) * ten(8 - e)).otherwise(size(c) / ten(e - 8))

    def add(frame: DataFrame, what: str, make) -> DataFrame:
        return frame.withColumns({f"{c}_{what}": make(c) for c in floats})

    finite = lambda x: (x > 0) & (x < float("inf"))
    rows = add(plain, "size", lambda c: F.when(finite(F.abs(F.col(c).cast("double"))), F.abs(F.col(c).cast("double"))))
    rows = add(rows, "guess", lambda c: F.floor(F.log10(size(c))))
    rows = add(rows, "rough", lambda c: scaled(c, at(c, "guess")))
    # The logarithm may be off by one beside a power of ten.
    rows = add(rows, "e", lambda c: F.when(at(c, "rough") >= 1e9, at(c, "guess") + 1).when(at(c, "rough") < 1e8, at(c, "guess") - 1).otherwise(at(c, "guess")))
    rows = add(rows, "s", lambda c: scaled(c, at(c, "e")))
    rows = add(rows, "unit", lambda c: ten(F.abs(at(c, "e") - 8)))
    # What looks like a half may be a little more or less: the sign of the difference from the half is worked out exactly.
    rows = add(rows, "tie", lambda c: F.floor(at(c, "s")) + F.lit(0.5))

    def side(c: str) -> Column:
        up, down = size(c) * at(c, "unit"), at(c, "tie") * at(c, "unit")
        return F.when(at(c, "e") < 8, (up - at(c, "tie")) + _excess(size(c), at(c, "unit"), up)).otherwise((size(c) - down) - _excess(at(c, "tie"), at(c, "unit"), down))

    exact = lambda c: (at(c, "s") == at(c, "tie")) & (F.abs(at(c, "e") - 8) <= 22)
    rows = add(rows, "side", lambda c: F.when(exact(c), side(c)).otherwise(0.0))
    rows = add(rows, "m", lambda c: F.when(at(c, "side") > 0, F.ceil("%s_s" % c)).when(at(c, "side") < 0, F.floor("%s_s" % c)).otherwise(F.rint(at(c, "s")).cast("long")))

    def text(c: str) -> Column:
        carry = at(c, "m") == 1_000_000_000  # rounding has made one figure more
        e, m = F.when(carry, at(c, "e") + 1).otherwise(at(c, "e")), F.when(carry, 100_000_000).otherwise(at(c, "m"))
        sign = F.when(F.col(c) < 0, "-").otherwise("")
        unit = ten(F.greatest(F.least(8 - e, F.lit(8)), F.lit(0))).cast("long")
        whole = (e >= 0) & (e <= 8) & (m % unit == 0)
        shown = F.when(whole, (m / unit).cast("long").cast("string")).otherwise(F.concat(m.cast("string"), F.lit("e"), e.cast("string")))
        return F.coalesce(F.when(F.isnan(c), "nan").when(F.abs(F.col(c)) == float("inf"), F.col(c).cast("string")).when(F.col(c) == 0, "0"), F.concat(sign, shown), F.lit(""))

    return rows.select(*((text(c) if c in floats else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in plain.columns))


def fingerprint(result: DataFrame) -> DataFrame:
    """(result_hash, n_rows) of a result set: rows in any order, duplicates counted, column names left out, ``empty`` if there are none.

    The sum of the rows' hashes is the same for every order, so nothing is sorted or collected, whatever the size.
    """
    shown = cells(result)
    row = F.concat_ws("\x1f", *shown.columns)
    part = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    total = shown.agg(F.sum(part).alias("s"), F.count("*").alias("n_rows"))
    return total.select(F.when(F.col("n_rows") == 0, "empty").otherwise(F.concat_ws(":", F.col("n_rows").cast("string"), F.col("s").cast("string"))).alias("result_hash"), "n_rows")


def is_refusal(stage: Column) -> Column:
    """Whether a run failed by refusing to send, not by being wrong."""
    return F.coalesce(stage.isin(*REFUSING), F.lit(False))


def usable(success: str = "success", result_hash: str = "result_hash") -> Column:
    h = F.col(result_hash)
    return F.col(success) & ~h.isin("", "empty") & ~h.startswith("error:") & ~h.startswith("truncated:")


def cost(results: DataFrame, prices: DataFrame) -> DataFrame:
    """``results`` with dollars; ``prices`` has model, price_in and price_out a million tokens. An unknown model costs nothing."""
    joined = results.join(prices, "model", "left")
    dollars = (F.col("prompt_tokens") * F.coalesce("price_in", F.lit(0.0)) + F.col("completion_tokens") * F.coalesce("price_out", F.lit(0.0))) / 1_000_000
    return joined.withColumn("dollars", F.round(dollars, 8)).drop("price_in", "price_out")


def score(results: DataFrame, reference: DataFrame) -> DataFrame:
    """``results`` with correct: null where the question has no reference (question, expected)."""
    correct = F.when(F.col("expected").isNotNull(), F.col("success") & (F.col("result_hash") == F.col("expected")))
    return results.join(reference, "question", "left").withColumn("correct", correct).drop("expected")


def consensus(results: DataFrame, votes: int = VOTES) -> DataFrame:
    """(question, expected): the hash that most usable runs of a question agree on; a tie for the first place is no consensus."""
    counts = results.filter(usable()).groupBy("question", "result_hash").agg(F.count("*").alias("votes"))
    order = Window.partitionBy("question").orderBy(F.desc("votes"), "result_hash")
    ranked = counts.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("votes").over(order))
    first = ranked.filter((F.col("place") == 1) & (F.col("votes") >= votes) & (F.col("next").isNull() | (F.col("next") < F.col("votes"))))
    return first.select("question", F.col("result_hash").alias("expected"))


def basis(results: DataFrame, gold: DataFrame) -> DataFrame:
    """(basis, n_questions): how many questions are scored by a reference query, by consensus, or not at all."""
    agreed = consensus(results).join(gold, "question", "left_anti").withColumn("basis", F.lit("consensus"))
    known = gold.select("question", F.lit("reference").alias("basis")).unionByName(agreed.select("question", "basis"))
    asked = results.select("question").distinct().join(known, "question", "left")
    return asked.groupBy(F.coalesce("basis", F.lit("none")).alias("basis")).agg(F.count("*").alias("n_questions"))


def vote(candidates: DataFrame) -> DataFrame:
    """The chosen attempt of each question: of the largest group with one result, then the surest group, the surest attempt."""
    surely = F.coalesce("perplexity", F.lit(UNSURE))
    groups = candidates.groupBy("question", "result_hash").agg(
        F.count("*").alias("agreeing"), F.min(surely).alias("best"), F.min("attempt").alias("first"), F.min(F.struct(surely.alias("p"), F.col("attempt"))).alias("pick")
    )
    order = Window.partitionBy("question").orderBy(F.desc("agreeing"), "best", "first")
    return groups.withColumn("place", F.row_number().over(order)).filter("place = 1").select("question", F.col("pick.attempt").alias("attempt"), "result_hash", "agreeing")


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(0.0)


def summarise(scored: DataFrame) -> DataFrame:
    """A row for each variant. Medians are exact."""
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    rows = scored.groupBy("variant").agg(
        F.count("*").alias("asked"), yes("success").alias("executed"), yes("correct").alias("correct"), F.count("correct").alias("scored"),
        yes("refusal").alias("refusals"), yes("escalated").alias("escalations"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"),
        F.round(F.sum(F.col("dollars").cast("decimal(28,8)")), 6).cast("double").alias("dollars"),
    )
    middle = medians(scored, ["variant"], {"ms": F.col("ms"), "perplexity": F.col("perplexity")})
    middle = middle.select("variant", F.round("ms", 1).alias("ms_median"), F.round("perplexity", 3).alias("perplexity_median"))
    rows = same(rows, middle, ["variant"], "left")
    return rows.withColumns(
        {
            "executable_rate": _rate(F.col("executed"), F.col("asked")),
            "accuracy": _rate(F.col("correct"), F.col("scored")),
            "tokens_per_question": F.bround(F.col("tokens") / F.col("asked")).cast("long"),
            "dollars_per_100": F.round(F.col("dollars") / F.col("asked") * 100, 4),
        }
    )


def failures(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("success") & F.col("failed_stage").isNotNull()).groupBy("variant", "failed_stage").agg(F.count("*").alias("n"))


def rank(summaries: DataFrame) -> DataFrame:
    """(place, variant, accuracy): by accuracy, then tokens, then latency. One row a variant, so the window is small."""
    order = Window.orderBy(F.desc("accuracy"), "tokens_per_question", "ms_median", "variant")
    return summaries.select("variant", "accuracy", F.row_number().over(order).alias("place"))


def rank_by_cost(summaries: DataFrame) -> DataFrame:
    """(place, variant, accuracy, dollars_per_100): by accuracy, then what a hundred questions cost, then latency."""
    order = Window.orderBy(F.desc("accuracy"), "dollars_per_100", "ms_median", "variant")
    return summaries.select("variant", "accuracy", "dollars_per_100", F.row_number().over(order).alias("place"))


def totals(attempts: DataFrame) -> DataFrame:
    """(run, calls, prompt_tokens, completion_tokens, tokens, dollars): what all attempts of a run took together."""
    sums = [F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens")]
    rows = attempts.groupBy("run").agg(F.count("*").alias("calls"), *sums, F.sum(F.col("dollars").cast("decimal(28,8)")).cast("double").alias("dollars"))
    return rows.withColumn("tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def outcomes(results: DataFrame, variants: list[str]) -> DataFrame:
    """A row for each question, a column for each variant: whether any of its runs succeeded."""
    return results.groupBy("question").pivot("variant", variants).agg(F.bool_or("success"))


def split_questions(results: DataFrame) -> DataFrame:
    """(question, kind): all runs fail, or variants differ in success."""
    one = results.groupBy("question", "variant").agg(F.bool_or("success").alias("ok")).groupBy("question").agg(F.bool_or("ok").alias("any"), F.bool_and("ok").alias("all"))
    kind = F.when(~F.col("any"), "all fail").when(~F.col("all"), "split")
    return one.select("question", kind.alias("kind")).filter("kind is not null")


def cascade(attempts: DataFrame, above: float = ESCALATE_ABOVE) -> DataFrame:
    """(run, rung, accepted, escalated): the first rung at or above the starting one that is valid and sure; else the last."""
    climbed = attempts.filter(F.col("rung") >= F.col("starting"))
    good = F.col("valid") & (F.coalesce("perplexity", F.lit(0.0)) <= above)
    picked = climbed.groupBy("run").agg(F.min(F.when(good, F.col("rung"))).alias("first"), F.max("rung").alias("last"), F.min("starting").alias("starting"))
    rung = F.coalesce("first", "last")
    return picked.select("run", rung.alias("rung"), F.col("first").isNotNull().alias("accepted"), (F.col("first").isNull() | (rung != F.col("starting"))).alias("escalated"))


def repaired(attempts: DataFrame) -> DataFrame:
    """(run, sql, rounds, history): the last attempt, with all of them in order."""
    rows = attempts.groupBy("run").agg(F.max_by("sql", "round").alias("sql"), F.count("*").alias("rounds"), F.array_sort(F.collect_list(F.struct("round", "sql"))).alias("h"))
    return rows.select("run", "sql", "rounds", F.array_join("h.sql", " | ").alias("history"))


def calibrate(scored: DataFrame) -> DataFrame:
    """The cut-off on perplexity, to two decimals, that best keeps right answers and catches wrong ones; the least on ties.

    Scores and cut-offs are put in one order and counted along it by value: the counts are first summed for each value, then
    within and over slices of the value range, so that no single task sorts all rows.
    """
    rows = scored.filter(F.col("perplexity").isNotNull() & F.col("correct").isNotNull())
    totals = rows.agg(
        F.count_if("correct").alias("right"), F.count_if(~F.col("correct")).alias("wrong"), F.count("*").alias("samples"),
    )
    middle = medians(rows, [], {"right": F.when(F.col("correct"), F.col("perplexity")), "wrong": F.when(~F.col("correct"), F.col("perplexity"))})
    middle = middle.select(F.round("right", 3).alias("median_when_right"), F.round("wrong", 3).alias("median_when_wrong"))
    totals = totals.crossJoin(F.broadcast(middle))  # one row and one row
    points = rows.select("perplexity", F.col("correct").cast("int").alias("r"), (~F.col("correct")).cast("int").alias("w"), F.lit(0).alias("cut"))
    cuts = rows.select(F.bround("perplexity", 2).alias("perplexity"), F.lit(0).alias("r"), F.lit(0).alias("w"), F.lit(1).alias("cut"))
    values = points.unionAll(cuts).groupBy("perplexity").agg(F.sum("r").alias("r"), F.sum("w").alias("w"), F.max("cut").alias("cut"))
    values = values.withColumn("slice", F.floor(F.col("perplexity")))
    slices = values.groupBy("slice").agg(F.sum("r").alias("sr"), F.sum("w").alias("sw"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("slice", F.coalesce(F.sum("sr").over(before), F.lit(0)).alias("br"), F.coalesce(F.sum("sw").over(before), F.lit(0)).alias("bw"))
    along = Window.partitionBy("slice").orderBy("perplexity").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = values.join(slices, "slice").withColumns({"kept": F.col("br") + F.sum("r").over(along), "passed": F.col("bw") + F.sum("w").over(along)}).filter("cut = 1")
    joined = counted.join(F.broadcast(totals), (totals["right"] > 0) & (totals["wrong"] > 0))  # one row
    score_ = F.col("kept") / F.col("right") + (F.col("wrong") - F.col("passed")) / F.col("wrong")
    best = joined.groupBy("median_when_right", "median_when_wrong", "samples").agg(F.max(F.struct(F.round(score_, 12).alias("s"), (-F.col("perplexity")).alias("t"))).alias("b"))
    return best.select((-F.col("b.t")).alias("threshold"), "median_when_right", "median_when_wrong", F.round(F.col("b.s") / 2, 3).alias("separates"), "samples")
