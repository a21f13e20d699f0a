"""Question sets and worked examples, as JSON lines: what is asked, and a query that answers it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegate.operators import gate

QUESTION = "question string, set string, values map<string, string>, concepts array<string>, tables array<string>, sql string"


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def read_questions(spark: SparkSession, folder: str) -> DataFrame:
    """(question, set, values, concepts, tables, sql): the entries that ask something. A reference query may be missing; malformed lines are left out."""
    rows = spark.read.schema(QUESTION + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(folder)
    return rows.filter(F.col("_corrupt_record").isNull() & ~blank(F.col("question"))).drop("_corrupt_record")


def rendered(question: Column, sql: Column) -> Column:
    """Fixed value: how a worked example reads in a message."""
    return F.concat(F.lit("Question: "), question, F.lit("\nSQL: "), sql)


def example_bank(examples: DataFrame, deny: gate.Denylist) -> DataFrame:
    """(question, sql, digest): worked examples that are whole and hold no stored value, and what registers each with the gate as an authored text.

    Question and query are looked at together, trimmed. Examples that repeat are one.
    """
    whole = examples.filter(~blank(F.col("question")) & ~blank(F.col("sql"))).select(F.trim("question").alias("question"), F.trim("sql").alias("sql")).distinct()
    told = whole.withColumn("id", F.sha2(rendered(F.col("question"), F.col("sql")), 256))
    leaking = gate.known_values(told.select("id", F.concat_ws(" ", "question", "sql").alias("text")), deny).select("id").distinct()
    return told.join(leaking, "id", "left_anti").select("question", "sql", F.col("id").alias("digest"))
