"""The append-only audit journal and run log: reading, appending and reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegate.operators.gate import TOKEN, fingerprint
from valuegate.operators.ranks import medians, same

LINE = "timestamp timestamp, context string, allowed boolean, length long, bypassed boolean, token_count long, fingerprint string, refused_tokens array<string>"


def verdict_lines(verdicts: DataFrame, texts: DataFrame, context: str, at: Column) -> DataFrame:
    """Journal lines of the gate's verdicts (id, allowed, refused, n_tokens, fingerprint) on texts (id, text)."""
    # The length is worked out first, so that texts are never shuffled.
    sent = texts.select("id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("length"))
    return sent.join(verdicts.select("id", "allowed", "refused", "n_tokens", "fingerprint"), "id").select(
        at.alias("timestamp"), F.lit(context).alias("context"), "allowed", "length", F.lit(False).alias("bypassed"),
        F.col("n_tokens").cast("long").alias("token_count"), "fingerprint", F.col("refused").alias("refused_tokens"),
    )


def bypass_lines(texts: DataFrame, context: str, at: Column) -> DataFrame:
    """Journal lines of texts that were sent past the gate on purpose."""
    none = F.array().cast("array<string>")
    length = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return texts.select(at.alias("timestamp"), F.lit(context).alias("context"), F.lit(True).alias("allowed"), length.alias("length"), F.lit(True).alias("bypassed"), F.lit(0).cast("long").alias("token_count"), F.lit("").alias("fingerprint"), none.alias("refused_tokens"))


def sweep_lines(known: DataFrame, texts: DataFrame, context: str, at: Column) -> DataFrame:
    """Journal lines of what came back with stored values in it; ``known`` are the gate's hits (id, value, size). Clean texts give none."""
    hits = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("s"), "value")))["value"].alias("refused"))
    text = F.coalesce("text", F.lit(""))
    found = texts.join(hits, "id").select("id", F.lit(False).alias("allowed"), "refused", F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("n_tokens"), fingerprint(text).alias("fingerprint"))
    return verdict_lines(found, texts, context, at)


def append(lines: DataFrame, folder: str) -> None:
    lines.write.mode("append").json(folder)


def clear(spark: SparkSession, folder: str) -> None:
    spark.createDataFrame([], LINE).write.mode("overwrite").json(folder)


def parsed(lines: DataFrame) -> DataFrame:
    """Journal lines (value) as rows; blank and malformed lines are left out, missing fields are null, bypassed false."""
    schema = LINE + ", _corrupt_record string"
    rows = lines.filter(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return rows.filter("_corrupt_record is null").drop("_corrupt_record").withColumn("bypassed", F.coalesce("bypassed", F.lit(False)))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(spark.read.text(folder))


def report(journal: DataFrame) -> DataFrame:
    """sends, blocked, allowed, bypassed, block_rate (0 when there is nothing) and the characters that were let out."""
    sent = journal.agg(
        F.count("*").alias("sends"), F.count_if(~F.col("allowed")).alias("blocked"), F.count_if("allowed").alias("allowed"), F.count_if(F.coalesce("bypassed", F.lit(False))).alias("bypassed"),
        F.coalesce(F.sum(F.when(F.col("allowed"), F.col("length"))), F.lit(0)).cast("long").alias("characters_sent"),
    )
    return sent.withColumn("block_rate", F.when(F.col("sends") > 0, F.round(F.col("blocked") / F.col("sends"), 4)).otherwise(0.0))


def egress(runs: DataFrame) -> DataFrame:
    """Of each arm: characters and stored values that were sent, and tokens."""
    return runs.groupBy("arm").agg(F.sum("chars").alias("chars"), F.sum("n_values").alias("n_values"), F.sum("tokens").alias("tokens"))


def step_latency(runs: DataFrame) -> DataFrame:
    """Milliseconds of each step and zone over runs with an array ``steps`` of (id, zone, ms)."""
    steps = runs.select(F.explode("steps").alias("s")).select("s.*")
    sums = steps.groupBy("id", "zone").agg(F.count("*").alias("n"), F.round(F.sum("ms"), 2).alias("total_ms"), F.max("ms").alias("max_ms"))
    middle = medians(steps, ["id", "zone"], {"median_ms": F.col("ms")}).withColumn("median_ms", F.round("median_ms", 2))
    return same(sums, middle, ["id", "zone"], "left").select("id", "zone", "n", "total_ms", "median_ms", "max_ms")


def step_detail(runs: DataFrame, fields: dict[str, tuple]) -> DataFrame:
    """Of each step and zone: how often it ran, how many details are malformed, its milliseconds, and ``fields`` of the details.

    ``fields`` maps a column to (path, type, aggregate). A detail is any JSON; it is read once into a variant, and a field that is absent or of
    another type is null.
    """
    steps = runs.select(F.explode("steps").alias("s")).select("s.*").withColumn("v", F.try_parse_json("detail"))
    picked = {name: F.when(F.schema_of_variant("v").isNotNull(), F.try_variant_get("v", path, kind)) for name, (path, kind, _) in fields.items()}
    rows = steps.select("id", "zone", "ms", F.col("v").isNull().alias("malformed"), *(c.alias(name) for name, c in picked.items()))
    return rows.groupBy("id", "zone").agg(F.count("*").alias("n"), F.count_if("malformed").alias("malformed"), F.round(F.sum("ms"), 2).alias("total_ms"), *(f(name).alias(name) for name, (_, _, f) in fields.items()))
