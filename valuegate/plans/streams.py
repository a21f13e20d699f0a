"""Streaming queries: the journal is made from ``events`` as files, read as a stream and run to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegate.operators import journal as jr
from valuegate.plans import evaluation as ev
from valuegate.plans import gate_plans as gp
from valuegate.plans.registry import Tables, query
from valuegate.sources.folders import new_folder
from valuegate.streaming import jobs


def _stream(t: Tables, rows: DataFrame, name: str) -> DataFrame:
    """The rows as files, read as a stream."""
    folder = new_folder(t.spark, name)
    if "timestamp" in rows.columns:  # watermarks need an instant
        rows = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    rows.write.parquet(folder)
    return t.spark.readStream.schema(rows.schema).parquet(folder)


def _plain(rows: DataFrame) -> DataFrame:
    """Window bounds as the events state their times, without a zone."""
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("stream_audit_report", f"WITH j AS ({ev.JOURNAL}) {ev._REPORT} FROM j")
def stream_audit_report(t: Tables) -> DataFrame:
    folder, lines = new_folder(t.spark, "stream-report"), t.sql(ev.JOURNAL)
    source = new_folder(t.spark, "journal")
    jr.append(lines.drop("event_id"), source)
    jobs.finish(jobs.report(jr.parsed(t.spark.readStream.text(source)), folder))
    return t.spark.read.parquet(folder)


@query(
    "stream_block_rate",
    f"""WITH j AS ({ev.JOURNAL}), w AS (SELECT date_trunc('hour', timestamp) AS start, count(*) AS sends, count_if(NOT allowed) AS blocked FROM j GROUP BY 1)
    SELECT start, start + INTERVAL 1 HOUR AS "end", sends, blocked, round(blocked / sends, 4) AS block_rate FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(timestamp)) - INTERVAL 10 MINUTE FROM j)""",
)
def stream_block_rate(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "stream-rate")
    jobs.finish(jobs.block_rate(_stream(t, t.sql(ev.JOURNAL), "journal"), folder))
    return _plain(t.spark.read.parquet(folder))


@query("stream_gate", f"{gp._BASE}, {gp._over(gp._REFUSED, 'messages')}, {gp._over(gp._VERDICT, 'messages')} SELECT id, allowed, array_to_string(refused, '|') AS refused, rule FROM verdict")
def stream_gate(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "stream-gate")
    jobs.finish(jobs.gate(_stream(t, gp.messages(t), "texts"), lambda batch: gp.verdict(t, batch), folder))
    return t.spark.read.parquet(folder).select("id", "allowed", F.array_join("refused", "|").alias("refused"), "rule")


@query(
    "stream_journal",
    f"{gp._BASE}, {gp._over(gp._REFUSED, 'messages')}, {gp._over(gp._VERDICT, 'messages')}, j AS (SELECT v.allowed, length(m.text)::bigint AS length, false AS bypassed FROM verdict v JOIN messages m USING (id)) {ev._REPORT} FROM j",
)
def stream_journal(t: Tables) -> DataFrame:
    """Messages pass the gate as a stream into the journal, which a second stream reports on; both stop half-way and go on where they were."""
    source, journal, report = (new_folder(t.spark, name) for name in ("texts", "stream-journal", "stream-report"))
    messages = gp.messages(t)
    for half in ("id % 2 = 0", "id % 2 <> 0"):
        messages.filter(half).write.mode("append").parquet(source)
        texts = t.spark.readStream.schema(messages.schema).parquet(source)
        jobs.finish(jobs.journal(texts, lambda batch: gp.verdict(t, batch), journal, "stream"))
        jobs.finish(jobs.report(jobs.follow(t.spark, journal), report))
    return t.spark.read.parquet(report)


_STEPS = "SELECT event_id, user_id AS run, ts AS timestamp, value AS ms FROM events"


@query(
    "stream_step_latency",
    f"""WITH s AS ({_STEPS}), g AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY run ORDER BY timestamp)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY run ORDER BY timestamp) AS session FROM g)
    SELECT run, min(timestamp) AS start, max(timestamp) + INTERVAL 30 MINUTE AS "end", count(*) AS steps, round(sum(ms), 2) AS ms FROM n GROUP BY run, session HAVING max(timestamp) + INTERVAL 30 MINUTE <= (SELECT date_trunc('milliseconds', max(timestamp)) - INTERVAL 10 MINUTE FROM s)""",
)
def stream_step_latency(t: Tables) -> DataFrame:
    folder, steps = new_folder(t.spark, "stream-steps"), t.sql(_STEPS)
    twice = steps.unionAll(steps.filter("event_id % 3 = 0"))  # some steps are delivered twice
    jobs.finish(jobs.sessions(_stream(t, twice, "steps"), folder))
    return _plain(t.spark.read.parquet(folder))
