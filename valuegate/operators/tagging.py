"""Glossary tagging of texts, and spans that other taggers deliver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuegate.functions import text as tx
from valuegate.operators.dictionary import phrases


def triggers(glossary: DataFrame) -> DataFrame:
    """(trigger, n, term, ord): the phrases of all terms as words; ``ord`` is the order in which equals are tried."""
    words = phrases(glossary).select("term", "ord", F.array_join(tx.tokens(F.col("phrase")), " ").alias("trigger"))
    return words.filter("trigger <> ''").select("trigger", F.size(F.split("trigger", " ")).alias("n"), "term", F.concat_ws(":", "term", F.lpad(F.col("ord").cast("string"), 4, "0")).alias("ord"))


def tag(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """(id, tags) of the texts (id, text) with terms: (position, n, term, trigger), ordered by position.

    More words go first; a word belongs to one match at most, also when its term was found before; of each term the first
    match counts. The matches of one text are folded in one row, no larger than the text.
    """
    known = triggers(glossary)
    sizes = sorted(r[0] for r in known.select("n").distinct().collect())  # lengths of phrases
    words = texts.select("id", tx.tokens(F.coalesce("text", F.lit(""))).alias("ws"))

    def grams(n: int) -> Column:
        starts = F.when(F.size("ws") >= n, F.sequence(F.lit(1), F.size("ws") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct((i - 1).alias("position"), F.array_join(F.slice("ws", i, n), " ").alias("trigger")))

    found = words.select("id", F.explode(F.concat(*map(grams, sizes))).alias("g")).select("id", "g.*").join(known, "trigger")
    order = F.struct((-F.col("n")).alias("a"), F.col("ord").alias("b"), F.col("position"), F.col("n"), F.col("term"), F.col("trigger"))
    rows = found.groupBy("id").agg(F.array_sort(F.collect_list(order)).alias("all"))
    kept = "array<struct<position:int,n:int,term:string,trigger:string>>"
    start = F.struct(F.array().cast("array<int>").alias("covered"), F.array().cast(kept).alias("kept"))

    def step(acc: Column, m: Column) -> Column:
        span = F.sequence(m["position"], m["position"] + m["n"] - 1)
        one = F.array(F.struct(m["position"].alias("position"), m["n"].alias("n"), m["term"].alias("term"), m["trigger"].alias("trigger")))
        new = ~F.exists(acc["kept"], lambda k: k["term"] == m["term"])
        taken = F.struct(F.concat(acc["covered"], span).alias("covered"), F.when(new, F.concat(acc["kept"], one)).otherwise(acc["kept"]).alias("kept"))
        return F.when(F.arrays_overlap(span, acc["covered"]), acc).otherwise(taken)

    return rows.select("id", F.array_sort(F.aggregate("all", start, step, lambda acc: acc["kept"])).alias("tags"))


def scope(tagged: DataFrame, glossary: DataFrame) -> DataFrame:
    """(id, columns, tables, notes): what the terms of a text imply, each in order of first appearance."""
    each = tagged.select("id", F.posexplode("tags").alias("place", "t")).select("id", "place", F.col("t.term").alias("term")).join(glossary, "term")
    rows = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "columns", "note"))).alias("m"))
    columns = F.array_distinct(F.flatten("m.columns"))
    tables = F.array_distinct(F.transform(columns, lambda c: F.substring_index(c, ".", 1)))
    return rows.select("id", columns.alias("columns"), tables.alias("tables"), F.filter("m.note", lambda n: n.isNotNull()).alias("notes"))


def flatten_entities(texts: DataFrame) -> DataFrame:
    """(id, type, entity, score, start, end) of texts with a map ``entities`` of type to (text, score, start, end); a missing place is looked up."""
    each = texts.select("id", "text", F.explode("entities").alias("type", "list")).select("id", "text", "type", F.explode("list").alias("e"))
    each = each.select("id", "text", "type", F.trim("e.text").alias("entity"), F.round("e.score", 4).alias("score"), F.col("e.start").alias("start"), F.col("e.end").alias("end")).filter("entity <> ''")
    at = F.instr(F.lower("text"), F.lower("entity")) - 1
    start = F.when(F.coalesce("start", F.lit(-1)) >= 0, F.col("start")).otherwise(at)
    end = F.when(F.coalesce("start", F.lit(-1)) >= 0, F.col("end")).when(at >= 0, at + F.length("entity")).otherwise(-1)
    return each.select("id", "type", "entity", F.coalesce("score", F.lit(0.0)).alias("score"), start.alias("start"), end.alias("end"))


def fallback_entities(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """(id, type, entity, score, start, end): the business terms of a text where no tagger is at hand, each half sure and without a place."""
    each = tag(texts, glossary).select("id", F.explode("tags").alias("t"))
    return each.select("id", F.col("t.term").alias("type"), F.col("t.trigger").alias("entity"), F.lit(0.5).alias("score"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))


def dedup_spans(entities: DataFrame) -> DataFrame:
    """(id, spans): longest first, then best; spans that overlap a kept one or repeat its text go; then by place."""
    order = F.struct((F.col("start") - F.col("end")).alias("a"), (-F.col("score")).alias("b"), "start", "end", "entity", "type")
    rows = entities.groupBy("id").agg(F.array_sort(F.collect_list(order)).alias("all"))
    kind = "array<struct<start:int,end:int,entity:string,type:string>>"

    def step(acc: Column, e: Column) -> Column:
        clash = F.exists(acc, lambda k: (F.lower(k["entity"]) == F.lower(e["entity"])) | ((k["start"] >= 0) & (e["start"] >= 0) & (e["start"] < k["end"]) & (k["start"] < e["end"])))
        one = F.array(F.struct(e["start"].alias("start"), e["end"].alias("end"), e["entity"].alias("entity"), e["type"].alias("type")))
        return F.when(clash, acc).otherwise(F.concat(acc, one))

    kept = F.aggregate("all", F.array().cast(kind), step)
    place = lambda s: F.when(s["start"] >= 0, s["start"]).otherwise(9999)
    return rows.select("id", F.array_sort(kept, lambda a, b: place(a) - place(b)).alias("spans"))


def entity_scope(entities: DataFrame, type_terms: DataFrame, glossary: DataFrame) -> DataFrame:
    """(id, columns): the columns of the terms that an entity's type stands for, in order, then the text's own (array ``fallback``)."""
    named = type_terms.select("type", F.posexplode("terms").alias("place", "term")).join(glossary.select("term", "columns"), "term")
    by = named.groupBy("type").agg(F.flatten(F.array_sort(F.collect_list(F.struct("place", "columns")))["columns"]).alias("own"))
    empty = F.array().cast("array<string>")
    return entities.join(by, "type", "left").select("id", F.array_distinct(F.concat(F.coalesce("own", empty), F.coalesce("fallback", empty))).alias("columns"))
