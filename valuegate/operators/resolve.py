"""Entity resolution: mentions of texts tied to stored values, columns or nothing, and the composed understanding of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valuegate.functions import text as tx
from valuegate.operators import search as se
from valuegate.sources.folders import stored

CONFIDENT, SETTLED, OUT_OF_SCOPE = 0.75, 0.99, 0.7


def resolve(entities: DataFrame, index: DataFrame, cards: DataFrame, heads: DataFrame, scope: DataFrame, generic: Column, tier_b: DataFrame | None = None) -> DataFrame:
    """``entities`` (id, place, mention, type, kind) with value, column, score, used (the span that was found), alternatives and out_of_scope.

    ``scope`` has type, ref and position; ``tier_b`` the values of columns that are resolved on demand. Values are looked up whole; where that is weak, shorter spans are tried in order: the
    first that is certain, else the best if it is better. A match outside the type's columns loses three tenths unless it is the
    mention itself; a column that the span names at least as well takes its place. What is found nowhere becomes a
    concept if it names a column, else stays an unresolved value.
    """
    wanted = entities.filter("kind = 'value'").select("mention", "type").distinct()
    spans = wanted.select("mention", "type", F.posexplode(F.concat(F.array("mention"), tx.subspans(F.col("mention"), generic))).alias("k", "span"))
    # The search reads its mentions once for each of its steps: both are written down.
    asked = stored(spans.select("type", F.col("span").alias("mention")).distinct(), "spans")
    found = stored(se.cascade(asked, index, scope, tier_b), "found").withColumnRenamed("mention", "span")
    by = [F.desc("score"), F.coalesce("position", F.lit(1 << 20)), F.length("value"), "value", "ref"]
    one = found.withColumn("p", F.row_number().over(Window.partitionBy("type", "span", "ref").orderBy(*by))).filter("p = 1")
    met = spans.join(one, ["type", "span"]).withColumn("r", F.row_number().over(Window.partitionBy("mention", "type", "k").orderBy(*by)))
    others = F.array_sort(F.collect_list(F.when((F.col("r") > 1) & (F.col("r") <= 4), F.struct("r", F.concat_ws(" = ", "ref", "value").alias("t")))))["t"]
    first = lambda c: F.max(F.when(F.col("r") == 1, F.col(c))).alias(c)
    one = met.groupBy("mention", "type", "k", "span").agg(first("value"), first("ref"), first("score"), F.bool_or("scoped").alias("scoped"), others.alias("alternatives"))
    whole = F.col("k") == 0
    strong = F.max(F.when(whole, F.col("score"))).over(Window.partitionBy("mention", "type"))
    pick = Window.partitionBy("mention", "type").orderBy(
        F.desc(whole & (F.col("score") >= CONFIDENT)), F.desc(F.col("score") >= SETTLED), F.when(F.col("score") >= SETTLED, F.col("k")), F.desc("score"), "k"
    )
    best = one.withColumn("strong", strong).withColumn("p", F.row_number().over(pick)).filter("p = 1")
    has_scope = scope.select("type").distinct().withColumn("limited", F.lit(True))
    best = best.join(has_scope, "type", "left")
    exact = F.lower(F.trim("value")) == F.lower(F.trim("span"))
    out = F.coalesce("limited", F.lit(False)) & ~F.col("scoped") & ~exact
    best = best.withColumns({"exact": exact, "out_of_scope": out, "score": F.round(F.col("score") * F.when(out, OUT_OF_SCOPE).otherwise(1.0), 4)})
    best = stored(best, "best")
    asked = best.select(F.col("span").alias("mention")).union(entities.filter("kind IN ('value', 'concept')").select("mention")).distinct()
    links = se.link_columns(asked, cards, heads, 1).select(F.col("mention").alias("named"), F.col("ref").alias("linked"), F.col("score").alias("link"))
    rows = entities.join(best.drop("k", "p", "strong", "limited", "scoped"), ["mention", "type"], "left").withColumn("named", F.coalesce("span", "mention")).join(links, "named", "left")
    taken = (F.col("kind") == "value") & F.col("value").isNotNull() & F.col("linked").isNotNull() & ~F.col("exact") & (F.col("link") >= F.col("score"))
    none = (F.col("kind") == "value") & F.col("value").isNull() & F.col("linked").isNotNull()
    value = (F.col("kind") == "value") & F.col("value").isNotNull() & ~taken
    return rows.select(
        "id", "place", "mention", "type", F.when(taken | none, "concept").otherwise(F.col("kind")).alias("kind"), F.when(value, F.col("value")).alias("value"),
        F.when(value, F.col("ref")).when(F.col("kind").isin("value", "concept"), F.col("linked")).alias("column"), F.when(value, F.col("score")).otherwise(0.0).alias("score"),
        F.col("named").alias("used"), F.when(taken, F.array(F.format_string("%s = %s (%.2f, not used)", "ref", "value", "score"))).otherwise(F.coalesce("alternatives", F.array().cast("array<string>"))).alias("alternatives"),
        F.coalesce(F.col("out_of_scope") & ~taken, F.lit(False)).alias("out_of_scope"),
    )


def missed_values(known: DataFrame, resolved: DataFrame, index: DataFrame) -> DataFrame:
    """(id, mention, value, column): stored values that stand in a text word for word and that no resolution of the text covers.

    ``known`` has (id, value) of the gate's search, so the stored value equals the mention but for case and spaces.
    """
    masked = (F.col("kind") == "value") & F.col("value").isNotNull() & (F.col("score") >= CONFIDENT)
    covered = resolved.select("id", F.lower("used").alias("m"), masked.alias("masked"))
    left = known.select("id", F.col("value").alias("mention")).join(covered, "id", "left")
    over = (F.col("masked") & F.contains("m", "mention")) | (F.col("m") == F.col("mention"))
    clear = left.groupBy("id", "mention").agg(F.bool_or(F.coalesce(over, F.lit(False))).alias("hit")).filter("not hit")
    stored = index.select("value", F.col("ref").alias("column"), F.lower(F.regexp_replace(F.trim("value"), r"\s+", " ")).alias("mention"))
    return clear.join(stored, "mention").groupBy("id", "mention").agg(F.min(F.struct("column", "value")).alias("v")).select("id", "mention", "v.value", "v.column")


def understand(texts: DataFrame, resolved: DataFrame, missed: DataFrame, scope: DataFrame) -> DataFrame:
    """(id, values, concepts, numbers, tables, notes): everything that is known about a text, in one row.

    ``scope`` is the glossary's (id, columns, tables, notes).
    """
    both = resolved.select("id", "mention", "kind", "value", "column", "score").unionByName(missed.select("id", "mention", F.lit("value").alias("kind"), "value", "column", F.lit(1.0).alias("score")))
    by = both.groupBy("id").agg(
        F.sort_array(F.collect_set(F.when(F.col("value").isNotNull(), F.concat_ws(" = ", "column", "value")))).alias("values"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "concept", F.col("column")))).alias("concepts"),
        F.collect_set(F.when(F.col("column").isNotNull(), F.substring_index("column", ".", 1))).alias("named"),
        F.array_sort(F.collect_set(F.when(F.col("value").isNotNull() & (F.col("score") >= CONFIDENT), F.struct((-F.length("mention")).alias("n"), "mention")))).alias("masked"),
    )
    empty = F.array().cast("array<string>")
    joined = texts.join(by, "id", "left").join(scope.select("id", F.col("tables").alias("implied"), "notes"), "id", "left")
    # Numbers inside a value that is masked are no numbers of the text.
    blank = F.transform(F.coalesce("masked", F.array().cast("array<struct<n:int,mention:string>>")), lambda m: F.struct(m["mention"].alias("mention"), F.lit(" ").alias("symbol")))
    open_ = tx.replace_in_order(F.coalesce("text", F.lit("")), blank)
    tables = F.array_sort(F.array_union(F.coalesce("named", empty), F.coalesce("implied", empty)))
    return joined.select("id", F.coalesce("values", empty).alias("values"), F.coalesce("concepts", empty).alias("concepts"), tx.numbers(open_).alias("numbers"), tables.alias("tables"), F.coalesce("notes", empty).alias("notes"))
