"""Masking of texts with symbols whose values stay in a vault, and pseudonyms for tables and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valuegate.functions import text as tx
from valuegate.operators.lookup import substring_pairs

CONFIDENT, USEFUL = 0.75, 0.65
#: The wording of a label's note.
SUBJECT, RELATED = " is the subject of the question", "; related columns: "


def number_symbols(resolutions: DataFrame) -> DataFrame:
    """``resolutions`` (id, mention, place, …) with symbol: :v1 is the longest mention of a text, equals go by place."""
    order = Window.partitionBy("id").orderBy(F.desc(F.length("mention")), "place")
    return resolutions.withColumn("symbol", F.concat(F.lit(":v"), F.row_number().over(order).cast("string")))


def spellings(mentions: DataFrame, values: DataFrame) -> DataFrame:
    """(mention, ref, n): how many distinct values of its column hold the mention, whatever the case; mentions that none holds have no row.

    Mentions are looked up among the values' distinct texts, not against all values of their column. An empty mention is in every value.
    """
    asked = mentions.select("mention", "ref", F.lower("mention").alias("part")).distinct()
    held = values.select("ref", F.lower("value").alias("text"), "value").distinct().groupBy("ref", "text").agg(F.count("*").alias("n"))
    met = asked.join(substring_pairs(asked, held), "part").join(held, ["ref", "text"])
    found = met.groupBy("mention", "ref").agg(F.sum("n").alias("n"))
    every = asked.filter("part = ''").join(held.groupBy("ref").agg(F.sum("n").alias("n")), "ref")
    return found.unionAll(every.select("mention", "ref", "n"))


def vault(numbered: DataFrame, counted: DataFrame) -> DataFrame:
    """(id, symbol, value, ref, pattern): what each symbol stands for; a pattern where the column has several spellings of the mention."""
    joined = numbered.join(counted, ["mention", "ref"], "left")
    pattern = F.when(F.col("n") > 1, F.concat(F.lit("%"), "mention", F.lit("%")))
    return joined.select("id", "symbol", "value", "ref", pattern.alias("pattern"))


def mask(texts: DataFrame, numbered: DataFrame) -> DataFrame:
    """(id, masked): every mention's first occurrence becomes its symbol, longest mentions first."""
    pairs = numbered.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.length("mention")).alias("a"), "place", "mention", "symbol"))).alias("pairs"))
    return texts.join(pairs, "id", "left").select("id", F.when(F.col("pairs").isNull(), F.col("text")).otherwise(tx.replace_in_order(F.col("text"), F.col("pairs"))).alias("masked"))


def unmask(masked: DataFrame, secrets: DataFrame) -> DataFrame:
    """(id, text): every symbol becomes its value again."""
    pairs = secrets.groupBy("id").agg(F.collect_list(F.struct(F.col("symbol").alias("old"), F.col("value").alias("new"))).alias("pairs"))
    return masked.join(pairs, "id", "left").select("id", F.when(F.col("pairs").isNull(), F.col("masked")).otherwise(tx.substitute(F.col("masked"), F.col("pairs"))).alias("text"))


def refusals(resolutions: DataFrame) -> DataFrame:
    """(id, reason, mentions): texts that cannot be masked, first because a person is named, else because a value is unknown or doubtful."""
    doubtful = (F.col("kind") == "value") & (F.col("value").isNull() | (F.col("score") < CONFIDENT))
    rows = resolutions.groupBy("id").agg(F.sort_array(F.collect_set(F.when(F.col("kind") == "person", F.col("mention")))).alias("persons"), F.sort_array(F.collect_set(F.when(doubtful, F.col("mention")))).alias("unknown"))
    reason = F.when(F.size("persons") > 0, "person named").when(F.size("unknown") > 0, "value not recognised")
    return rows.select("id", reason.alias("reason"), F.array_join(F.when(F.size("persons") > 0, F.col("persons")).otherwise(F.col("unknown")), "|").alias("mentions")).filter("reason is not null")


def suggestions(resolutions: DataFrame, most: int = 4) -> DataFrame:
    """(id, mention, offered): for each value that is unknown or doubtful the stored values worth offering: its own match if it is near enough, then the ``alternatives`` (column = value)."""
    doubtful = (F.col("kind") == "value") & (F.col("value").isNull() | (F.col("score") < CONFIDENT))
    own = F.when(F.col("value").isNotNull() & (F.col("score") >= USEFUL), F.array("value")).otherwise(F.array().cast("array<string>"))
    others = F.filter(F.transform("alternatives", lambda a: F.when(F.contains(a, F.lit(" = ")), F.substring(a, F.length(F.substring_index(a, " = ", 1)) + 4, F.length(a)))), lambda v: F.coalesce(v != "", F.lit(False)))
    return resolutions.filter(doubtful).select("id", "mention", F.slice(F.array_distinct(F.concat(own, others)), 1, most).alias("offered"))


def confidence(resolutions: DataFrame) -> DataFrame:
    """``resolutions`` with status: confident, needs confirmation, unresolved, or not a value."""
    status = F.when(F.col("kind") != "value", "not a value").when(F.col("value").isNull(), "unresolved").when(F.col("score") >= CONFIDENT, "confident").otherwise("needs confirmation")
    return resolutions.withColumn("status", status)


def public_view(state: DataFrame, declared: list[str]) -> DataFrame:
    """Only the declared columns cross the boundary; of maps and arrays their sizes alone."""
    out = []
    for name in declared:
        kind = state.schema[name].dataType.typeName()
        out.append(F.size(name).alias(f"n_{name}") if kind in ("array", "map") else F.col(name))
    return state.select(*out)


def labels(names: DataFrame, letter: str, seed: int) -> DataFrame:
    """(name, label): labels in an order that hangs on the seed; the same name has the same label. There is a row for each schema name."""
    order = Window.orderBy(F.md5(F.concat(F.lit(str(seed)), "name")))
    return names.select("name").distinct().withColumn("label", F.concat(F.lit(letter), F.row_number().over(order).cast("string")))


def pseudonymise(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The table under opaque column names. ``mapping`` has a name for each column."""
    return df.toDF(*(mapping[c] for c in df.columns))


def relations(links: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_label, column_label, ref_table_label, ref_column_label): foreign keys under their labels; keys that lead out of the labelled tables would name one, so they are left out."""
    named = lambda names, c: names.select(F.col("name").alias(c), F.col("label").alias(f"{c}_label"))
    rows = links.join(named(tables, "table_name"), "table_name").join(named(tables, "ref_table"), "ref_table")
    rows = rows.join(named(columns, "column_name"), "column_name").join(named(columns, "ref_column"), "ref_column")
    return rows.select(F.col("table_name_label").alias("table_label"), F.col("column_name_label").alias("column_label"), "ref_table_label", "ref_column_label")


def restore(log: DataFrame, mapping: list[tuple[str, str]]) -> DataFrame:
    """(log_id, sql): labels become the real names again. ``mapping`` is (name, label), as many as the schema has names."""
    pairs = F.array(*(F.struct(F.lit(label).alias("old"), F.lit(name).alias("new")) for name, label in mapping))
    return log.select("log_id", tx.substitute(F.col("sql"), pairs).alias("sql"))


def invented(log: DataFrame, issued: list[str]) -> DataFrame:
    """(log_id, invented): labels that were never issued."""
    used = F.array_distinct(tx.find_all(F.col("sql"), r"(?<![A-Za-z0-9_])([tc]\d+)(?![A-Za-z0-9_])", 1))
    return log.select("log_id", F.array_sort(F.array_except(used, F.array(*map(F.lit, issued)))).alias("invented"))


def rewrite(texts: DataFrame, tagged: DataFrame, glossary: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(id, text): business words become the label of their term's first column that has one. ``mapping`` is reference to label."""
    pairs = F.array(*(F.struct(F.lit(r).alias("ref"), F.lit(x).alias("label")) for r, x in mapping.items()))
    first = F.get(F.filter(F.transform("columns", lambda c: F.get(F.filter(pairs, lambda p: p["ref"] == c), F.lit(0))["label"]), lambda x: x.isNotNull()), F.lit(0))
    aliases = glossary.select("term", first.alias("alias")).filter("alias is not null")
    each = tagged.select("id", F.explode("tags").alias("t")).select("id", F.col("t.term").alias("term"), F.col("t.trigger").alias("trigger")).join(aliases, "term")
    by = each.groupBy("id").agg(F.collect_list(F.struct(F.concat(F.lit("\\E(?i)\\Q"), "trigger").alias("old"), F.col("alias").alias("new"))).alias("pairs"))
    return texts.join(by, "id", "left").select("id", F.when(F.col("pairs").isNull(), F.col("text")).otherwise(tx.substitute(F.col("text"), F.col("pairs"))).alias("text"))


def rewrite_notes(tagged: DataFrame, glossary: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(id, notes): of each label that a text's words became, what it is and which labelled columns of its term go with it, in the order of the triggers' length."""
    pairs = F.array(*(F.struct(F.lit(r).alias("ref"), F.lit(x).alias("label")) for r, x in mapping.items()))
    labelled = F.filter(F.transform("columns", lambda c: F.get(F.filter(pairs, lambda p: p["ref"] == c), F.lit(0))["label"]), lambda x: x.isNotNull())
    terms = glossary.select("term", labelled.alias("labels")).filter(F.size("labels") > 0)
    each = tagged.select("id", F.explode("tags").alias("t")).select("id", F.col("t.term").alias("term"), F.length("t.trigger").alias("n"), F.col("t.position").alias("at")).join(terms, "term")
    first = each.groupBy("id", F.col("labels")[0].alias("label")).agg(F.min(F.struct((-F.col("n")).alias("a"), F.col("at").alias("b"), "labels")).alias("m"))
    related = F.slice("m.labels", 2, 3)
    note = F.concat("label", F.lit(SUBJECT), F.when(F.size(related) > 0, F.concat(F.lit(RELATED), F.array_join(related, ", "))).otherwise(""))
    return first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("m.a", "m.b", note.alias("note"))))["note"].alias("notes"))


def labelled_recall(expected: DataFrame, resolved: DataFrame) -> DataFrame:
    """(set, expected, found, extra, recall, precision) over (set, id, item) rows."""
    want, got = expected.distinct().withColumn("w", F.lit(1)), resolved.distinct().withColumn("g", F.lit(1))
    rows = want.join(got, ["set", "id", "item"], "full").groupBy("set").agg(F.count("w").alias("expected"), F.count(F.when(F.col("w").isNotNull(), F.col("g"))).alias("found"), F.count(F.when(F.col("w").isNull(), F.col("g"))).alias("extra"))
    return rows.withColumns({"recall": F.round(F.col("found") / F.col("expected"), 4), "precision": F.round(F.col("found") / (F.col("found") + F.col("extra")), 4)})
