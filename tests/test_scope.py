"""Searches within a scope read the scope's columns only."""

from valuegate.operators import index as ix
from valuegate.operators import search


def test_a_scope_prunes_the_index(spark, tmp_path):
    refs = [f"t.c{k}" for k in range(20)]
    values = spark.createDataFrame([(f"value {k} {n}", r) for k, r in enumerate(refs) for n in range(30)], "value string, ref string")
    ix.write(values, f"file://{tmp_path}/index")
    index = spark.read.schema("value string, ref string").parquet(f"file://{tmp_path}/index")
    scope = spark.createDataFrame([("kind", "t.c3", 0), ("kind", "t.c7", 1), ("other", "t.c9", 0)], "type string, ref string, position int")
    near = search.within(index, scope.filter("type = 'kind'"))
    assert {r["ref"] for r in near.select("ref").distinct().collect()} == {"t.c3", "t.c7"} and near.count() == 60
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan then shows its scan
    frame = near.select("value", "ref")
    frame.collect()
    spark.conf.unset("spark.sql.adaptive.enabled")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    # Files that the scan has read, as its metric says.
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    read = [leaves.apply(i).metrics().get("numFiles") for i in range(leaves.size())]
    every = len({f for f in index.inputFiles()})
    assert any(m.isDefined() and 0 < m.get().value() <= every * 2 // 20 for m in read)


def test_the_scope_decides_before_all_columns(spark):
    index = spark.createDataFrame([("aspirin", "a.x"), ("aspirin plus", "b.y"), ("ibuprofen", "b.y"), ("paracetamol", "c.z")], "value string, ref string")
    scope = spark.createDataFrame([("drug", "b.y", 0), ("place", "c.z", 0)], "type string, ref string, position int")
    asked = spark.createDataFrame([("drug", "aspirin"), ("drug", "ibuprofn"), ("place", "aspirin"), (None, "paracetamol"), ("drug", "zzz"), ("drug", "aspirin")], "type string, mention string")
    got = {(r["type"], r["mention"], r["value"], r["scoped"]) for r in search.cascade(asked, index, scope).collect()}
    assert got == {
        ("drug", "aspirin", "aspirin plus", True), ("drug", "ibuprofn", "ibuprofen", True),
        ("place", "aspirin", "aspirin", False), ("place", "aspirin", "aspirin plus", False), (None, "paracetamol", "paracetamol", False),
    }
    assert search.cascade(asked, index.limit(0), scope).count() == 0
