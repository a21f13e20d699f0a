"""Entity resolution over the messages, with the mentions that a tagger would deliver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegate.operators import resolve as rs
from valuegate.operators import tagging as tg
from valuegate.plans import gate_plans as gp
from valuegate.plans import profiling as pr
from valuegate.plans import text_plans as tp
from valuegate.plans.registry import Tables, query
from valuegate.sources.folders import stored

ENTITIES = """SELECT o_orderkey AS id, 0 AS place, lower(c_mktsegment) AS mention, 'segment' AS type FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT o_orderkey, 1, CASE o_orderkey % 4 WHEN 0 THEN 'market segment' WHEN 1 THEN 'the blu anvil' WHEN 2 THEN substr(o_orderpriority, 3) ELSE 'zzqqx' END, 'product' FROM orders WHERE o_orderkey % 3 <> 0"""


def resolved(t: Tables) -> DataFrame:
    entities = t.sql(ENTITIES)
    kinds = stored(tp.mention_kinds(t, entities.select("mention", "type").distinct()).distinct(), "kinds")
    scope = t.spark.createDataFrame([("segment", "customer.c_mktsegment", 0), ("product", "part.p_name", 0), ("product", "part.p_type", 1)], "type string, ref string, position int")
    return rs.resolve(entities.join(kinds, "mention"), pr.index(t), stored(pr.cards(t), "cards"), stored(pr.head_words(t), "heads"), scope, tp._generic(), pr.tier_b(t))


@query("entity_resolution")
def entity_resolution(t: Tables) -> DataFrame:
    return resolved(t)


def missed(t: Tables, found: DataFrame) -> DataFrame:
    return rs.missed_values(gp.known(t, gp.messages(t)), found, pr.index(t))


@query("missed_values")
def missed_values(t: Tables) -> DataFrame:
    return missed(t, stored(resolved(t), "resolved"))


@query("understand_batch")
def understand_batch(t: Tables) -> DataFrame:
    texts, glossary, found = gp.messages(t), pr.glossary(t), stored(resolved(t), "resolved")
    return rs.understand(texts, found, stored(missed(t, found), "missed"), tg.scope(tg.tag(texts, glossary), glossary)).withColumn("n_numbers", F.size("numbers"))
