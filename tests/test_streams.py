"""The streamed journal across crashes and restarts: no line twice, none lost."""

import pytest
from pyspark.sql import functions as F

from valuegate.operators import journal as jr
from valuegate.streaming import jobs


def verdicts(batch):
    return batch.select("id", (F.col("id") % 3 != 0).alias("allowed"), F.array(F.lit("x")).alias("refused"), F.lit(2).alias("n_tokens"), F.lit("f").alias("fingerprint"))


def test_crashes_leave_each_line_once(spark, tmp_path, monkeypatch):
    source, folder = f"file://{tmp_path}/texts", f"file://{tmp_path}/journal"
    kind = "id long, text string"
    add = lambda a, b: spark.createDataFrame([(i, f"text {i}") for i in range(a, b)], kind).coalesce(1).write.mode("append").parquet(source)
    writer = lambda judge=verdicts: jobs.journal(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source), judge, folder, "test")
    for k in range(4):
        add(10 * k, 10 * k + 10)
    whole, calls = jobs.moved, []

    def breaks_after(*args):
        done = whole(*args)
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("the driver is gone after the second batch was published")
        return done

    monkeypatch.setattr(jobs, "moved", breaks_after)
    with pytest.raises(Exception, match="the driver is gone"):
        jobs.finish(writer())
    assert jr.scan(spark, f"{folder}/*").count() == 20

    def breaks_before(batch):
        raise RuntimeError("the driver is gone before the third batch")

    with pytest.raises(Exception, match="before the third batch"):
        jobs.finish(writer(breaks_before))  # the second batch comes again and is left as it is
    report = f"file://{tmp_path}/report"
    jobs.finish(jobs.report(jobs.follow(spark, folder), report))
    assert spark.read.parquet(report).first()["sends"] == 20
    jobs.finish(writer())
    add(40, 45)
    jobs.finish(writer())
    lengths = sorted(r["length"] for r in jr.scan(spark, f"{folder}/*").collect())
    assert lengths == sorted(len(f"text {i}") for i in range(45))
    jobs.finish(jobs.report(jobs.follow(spark, folder), report))  # goes on from its state: the first lines are not read again
    row = spark.read.parquet(report).first()
    assert (row["sends"], row["blocked"]) == (45, 15)
