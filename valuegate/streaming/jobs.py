"""Structured Streaming jobs over append-only journals; each writes to a folder and keeps its progress beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegate.operators import journal as jr
from valuegate.sources.kept import exists, moved


def report(lines: DataFrame, folder: str):
    """Running audit report: after every batch the folder holds the report of all lines so far."""

    def store(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    return jr.report(lines).writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", f"{folder}-progress")


def block_rate(lines: DataFrame, folder: str, size: str = "1 hour", late: str = "10 minutes"):
    """Block rate of each tumbling window, written once the watermark has passed its end; later lines are dropped."""
    windows = lines.withWatermark("timestamp", late).groupBy(F.window("timestamp", size)).agg(F.count("*").alias("sends"), F.count_if(~F.col("allowed")).alias("blocked"))
    rows = windows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "sends", "blocked", F.round(F.col("blocked") / F.col("sends"), 4).alias("block_rate"))
    return rows.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", f"{folder}-progress")


def gate(texts: DataFrame, verdicts: Callable[[DataFrame], DataFrame], folder: str):
    """Verdicts of a stream of texts against the static values, a folder for each batch, so that a repeated batch replaces itself."""

    def store(batch: DataFrame, number: int) -> None:
        verdicts(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return texts.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}-progress")


def published(lines: DataFrame, folder: str, number: int) -> None:
    """The lines of one batch, once: written aside and moved into place whole. A batch that is repeated after a crash finds its folder there and
    leaves it as it is, so what reads the folder as a stream sees each line once."""
    place = f"{folder}/batch={number}"
    if exists(lines.sparkSession, place):
        return
    draft = f"{folder}-drafts/{number}-{uuid.uuid4().hex}"
    lines.write.json(draft)
    moved(lines.sparkSession, draft, place)


def journal(texts: DataFrame, verdicts: Callable[[DataFrame], DataFrame], folder: str, context: str):
    """The gate as a stream into the journal: each batch's verdicts become journal lines, exactly once whatever restarts there are."""

    def store(batch: DataFrame, number: int) -> None:
        batch = batch.select("id", "text")
        published(jr.verdict_lines(verdicts(batch), batch, context, F.current_timestamp()), folder, number)

    return texts.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}-progress")


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """The journal that ``journal`` writes, as a stream of lines."""
    return jr.parsed(spark.readStream.option("recursiveFileLookup", "true").text(folder))


def sessions(steps: DataFrame, folder: str, gap: str = "30 minutes", late: str = "10 minutes"):
    """Steps and milliseconds of each run's sessions; a step that is delivered twice counts once."""
    once = steps.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["event_id"])
    rows = once.groupBy("run", F.session_window("timestamp", gap).alias("s")).agg(F.count("*").alias("steps"), F.round(F.sum("ms"), 2).alias("ms"))
    out = rows.select("run", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "steps", "ms")
    return out.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", f"{folder}-progress")


def finish(writer) -> None:
    """Run over what is there and stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    query.stop()
