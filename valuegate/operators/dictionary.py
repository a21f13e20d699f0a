"""Dictionaries: business terms with synonyms, columns and notes; allowed words; and what the schema adds to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegate.sources.local import local_rows

TERM = "term string, synonyms array<string>, columns array<string>, note string"


def terms(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return local_rows(spark, rows, TERM)


def split_list(column: Column) -> Column:
    """The entries of a comma-separated line, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(column, ","), lambda w: F.trim(w)), lambda w: w != "")


def phrases(glossary: DataFrame) -> DataFrame:
    """(term, phrase, ord): the term's own name and its synonyms, in order."""
    every = F.concat(F.array(F.regexp_replace("term", "_", " ")), "synonyms")
    return glossary.select("term", F.posexplode(every).alias("ord", "phrase"))


def concept_words(glossary: DataFrame) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower("phrase"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word")
    return phrases(glossary).select(words).filter(F.length("word") > 1).distinct()


def schema_words(columns: DataFrame) -> DataFrame:
    """Table and column names and their parts between underscores."""
    names = columns.select(F.lower("table_name").alias("name")).unionAll(columns.select(F.lower("column_name"))).distinct()
    return names.select(F.explode(F.concat(F.array("name"), F.split("name", "_"))).alias("word")).filter("word <> ''").distinct()


def allowlist(sources: dict[str, DataFrame]) -> DataFrame:
    """(word, sources): every allowed word and where it comes from."""
    tagged = [words.select("word", F.lit(name).alias("source")) for name, words in sources.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy("word").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def filled(columns: dict[str, DataFrame]) -> DataFrame:
    """(ref, n): how many rows of its table have a value in each referenced column (``table.column``)."""
    parts = [frame.agg(F.count(ref.split(".")[1]).alias("n")).select(F.lit(ref).alias("ref"), "n") for ref, frame in columns.items()]
    return reduce(DataFrame.unionAll, parts)


def integrity(glossary: DataFrame, columns: DataFrame, counts: DataFrame) -> DataFrame:
    """(term, problem): terms without columns, columns that do not exist, and columns without any value."""
    none = glossary.filter(F.size("columns") == 0).select("term", F.lit("no column declared").alias("problem"))
    refs = glossary.select("term", F.explode("columns").alias("ref"))
    known = columns.select(F.concat_ws(".", "table_name", "column_name").alias("ref"))
    unknown = refs.join(known, "ref", "left_anti").select("term", F.concat("ref", F.lit(": unknown column")).alias("problem"))
    return none.unionAll(unknown).unionAll(refs.join(counts.filter("n = 0"), "ref").select("term", F.concat("ref", F.lit(": no value"))))


def cards(columns: DataFrame, indexed: DataFrame, glossary: DataFrame) -> DataFrame:
    """(ref, table_name, column_name, synonyms): columns that a mention may name.

    Structural columns (keys, offsets, text columns that are not in the index) are left out unless the glossary names them.
    """
    refs = phrases(glossary).join(glossary.select("term", F.explode("columns").alias("ref")), "term")
    known = refs.groupBy("ref").agg(F.array_sort(F.collect_set("phrase")).alias("synonyms"))
    every = columns.withColumn("ref", F.concat_ws(".", "table_name", "column_name"))
    every = every.join(known, "ref", "left").join(indexed.select("ref", F.lit(True).alias("in_index")), "ref", "left")
    structural = F.lower("column_name").rlike("(id|key|offset)$") | ((F.col("compact_type") == "TEXT") & F.col("in_index").isNull())
    return every.filter(~structural | F.col("synonyms").isNotNull()).select("ref", "table_name", "column_name", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"))
