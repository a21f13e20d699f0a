"""The stages of the corpus pipeline. All but the last return the columns of the documents that they are given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegate.llm import op3_decontamination, op5_packing, op6_toxicity, op9_minhash_near_dedup, op10_secret_scan
from valuegate.llm.storage import table

VOCABULARY = "word_bpe_49k.json"


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; null and empty texts score low and stay. Narrow after training."""
    model = op6_toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = op6_toxicity.document_score(model)
    return docs.filter(score(F.coalesce("text", F.lit(""))) < 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the least id; of rows that agree in id and text one stays, the first by a hash of the row."""
    kept = op9_minhash_near_dedup.groups(docs).filter("kept").select("key").distinct()
    # Beside its key a row is one column, so no name of it can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), op9_minhash_near_dedup.row_key(F.col("doc_id").cast("long"), F.col("text")).alias("key"), F.xxhash64(*docs.columns).alias("order"))
    one = rows.groupBy("key").agg(F.min_by("row", "order").alias("row"))
    # The kept keys grow with the corpus: never broadcast.
    return one.join(kept.hint("merge"), "key", "left_semi").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one with exchanged values, go, whatever their id."""
    found = op3_decontamination.matches(docs, table(spark, sf_dir, "benchmark")).select("key").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), op3_decontamination.text_key(F.col("text")).alias("key"))
    return rows.join(found, "key", "left_anti").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced by a mask; no document goes. ``n_chars`` follows the text."""
    model = op10_secret_scan.train(op10_secret_scan.corpus_samples(docs))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    scanned = op10_secret_scan.scan(rows, model).select("row", "text", "found.spans")
    text = F.when(F.size("spans") > 0, op10_secret_scan.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    changed = scanned.select("row", "spans", text.alias("text"))
    length = lambda kind: F.when(F.size("spans") > 0, F.length("text").cast(kind)).otherwise(F.col("row.n_chars"))
    made = {"text": F.col("text")} | ({"n_chars": length(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return changed.select(*(made.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its sequence, its place there and its ids."""
    return op5_packing.pack_documents(docs, _vocabulary())
