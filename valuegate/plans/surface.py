"""The relational query surface: filters, joins, aggregations, ordering, set operations and the SQL text that may be run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegate.operators import relational as rel
from valuegate.plans.registry import TABLES, Tables, query, sql_query

# Filters and projections


@query("scan_tables", " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*)::bigint AS n_rows FROM {name}" for name in TABLES))
def scan_tables(t: Tables) -> DataFrame:
    return rel.row_counts(t.all())


sql_query(
    "bound_query",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = :v1 AND o_totalprice > :v2",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000",
    {"v1": "1-URGENT", "v2": 400000},
)


@query("filter_like_ci", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%'")
def filter_like_ci(t: Tables) -> DataFrame:
    return t("part").filter(rel.contains_ci("p_name", "RING")).select("p_partkey", "p_name")


@query("filter_nonblank", "SELECT doc_id, lang FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def filter_nonblank(t: Tables) -> DataFrame:
    return t("documents").filter(rel.nonblank("text")).select("doc_id", "lang")


@query("filter_dirty_numeric", "SELECT p_partkey, p_brand FROM part WHERE coalesce(try_cast(regexp_replace(p_brand, '^Brand#', CASE WHEN p_size % 2 = 0 THEN '' ELSE '> ' END) AS integer), 0) > 12")
def filter_dirty_numeric(t: Tables) -> DataFrame:
    part = t("part").withColumn("dirty", F.regexp_replace("p_brand", F.lit("^Brand#"), F.when(F.col("p_size") % 2 == 0, "").otherwise("> ")))
    return part.filter(rel.dirty_int("dirty") > 12).select("p_partkey", "p_brand")


@query("distinct_values", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct_values(t: Tables) -> DataFrame:
    return t("customer").select("c_mktsegment", "c_nationkey").distinct().orderBy("c_mktsegment", "c_nationkey")


# Joins and aggregations


@query(
    "join_count_distinct",
    "SELECT n_name, count(DISTINCT o_custkey)::bigint AS n_customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
)
def join_count_distinct(t: Tables) -> DataFrame:
    facts = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return facts.groupBy("n_name").agg(F.count_distinct("o_custkey").alias("n_customers"))


@query(
    "join_conjunction",
    "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def join_conjunction(t: Tables) -> DataFrame:
    orders = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    sides = [orders.filter(F.col("o_orderpriority") == "1-URGENT"), orders.filter(F.col("o_orderstatus") == "P")]
    return rel.having_all(t("customer"), sides, "c_custkey").select("c_custkey")


@query("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey)::bigint AS n_parts, count(DISTINCT l_suppkey)::bigint AS n_suppliers FROM lineitem GROUP BY l_returnflag")
def agg_count_distinct(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n_parts"), F.count_distinct("l_suppkey").alias("n_suppliers"))


@query(
    "agg_average",
    "SELECT l_returnflag, round(avg(l_quantity), 4) AS avg_quantity, round(avg(CASE WHEN l_discount > 0.05 THEN l_extendedprice END), 2) AS avg_discounted, round(avg(l_quantity / 1440.0), 6) AS avg_days FROM lineitem GROUP BY l_returnflag",
)
def agg_average(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_returnflag").agg(
        F.round(F.avg("l_quantity"), 4).alias("avg_quantity"),
        F.round(F.avg(F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice"))), 2).alias("avg_discounted"),
        F.round(F.avg(rel.minutes_to_days("l_quantity")), 6).alias("avg_days"),
    )


@query("agg_share", "SELECT l_linestatus, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY l_linestatus")
def agg_share(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_linestatus").agg(F.round(rel.share(F.col("l_returnflag") == "R"), 6).alias("share"))


@query("agg_ratio", "SELECT o_orderpriority, round(count(*)::double / count(DISTINCT o_custkey), 6) AS orders_per_customer FROM orders GROUP BY o_orderpriority")
def agg_ratio(t: Tables) -> DataFrame:
    return t("orders").groupBy("o_orderpriority").agg(F.round(rel.rows_per("o_custkey"), 6).alias("orders_per_customer"))


@query("agg_group_topn", "SELECT p_name, count(*)::bigint AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 10")
def agg_group_topn(t: Tables) -> DataFrame:
    return rel.top_groups(t("part"), "p_name", 10)


@query("argmax_with_ties", "SELECT p_partkey, p_size FROM part WHERE p_size = (SELECT max(p_size) FROM part)")
def argmax_with_ties(t: Tables) -> DataFrame:
    return rel.at_maximum(t("part"), "p_size").select("p_partkey", "p_size")


@query("top1_tiebreak", "SELECT c_mktsegment, count(*)::bigint AS n FROM customer GROUP BY c_mktsegment ORDER BY n DESC, c_mktsegment LIMIT 1")
def top1_tiebreak(t: Tables) -> DataFrame:
    return rel.top_groups(t("customer"), "c_mktsegment", 1)


@query("row_cap", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) > 2000 AS truncated FROM orders ORDER BY o_orderkey LIMIT 2000")
def row_cap(t: Tables) -> DataFrame:
    return rel.capped(t("orders").select("o_orderkey", "o_totalprice"), 2000, "o_orderkey")


@query("cells_exposed", "SELECT (count(o_orderkey) + count(o_orderstatus) + count(o_totalprice))::bigint AS cells FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice FROM orders)")
def cells_exposed(t: Tables) -> DataFrame:
    return rel.filled_cells(t("orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), "o_totalprice"))


# Query text

sql_query("sql_outer_joins", """SELECT n_name, s_suppkey, r_name FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 FULL JOIN region ON r_regionkey = n_regionkey AND r_name <> 'ASIA'""")
sql_query("sql_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice BETWEEN 400000 AND 450000)")
sql_query("sql_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 250000) AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
sql_query(
    "sql_aggregates",
    "SELECT l_shipdate > timestamp '2000-01-01' AS late, count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_tax), 6) AS mean, min(l_discount) AS low, max(l_discount) AS high, round(coalesce(sum(CASE WHEN l_tax > 1 THEN l_tax END), 0.0), 2) AS none FROM lineitem GROUP BY l_shipdate > timestamp '2000-01-01'",
)
sql_query(
    "sql_scalars",
    "SELECT c_custkey, round(c_acctbal, 1) AS r, abs(c_acctbal) AS a, try_cast(substr(c_name, 10) AS bigint) AS number, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer",
)
sql_query("sql_set_ops", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_regionkey FROM nation UNION SELECT r_regionkey FROM region)")
sql_query(
    "sql_recursive",
    "WITH RECURSIVE steps(k, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, s.depth + 1 FROM steps s JOIN nation n ON n.n_nationkey = s.k + 1) SELECT k, depth FROM steps",
)
sql_query(
    "sql_windows",
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders",
)
sql_query("sql_strings", "SELECT p_partkey, substr(p_name, 2, 4) AS part_of, length(p_name) AS n, upper(p_type) AS u, lower(p_brand) AS l, trim(concat(' ', p_name, ' ')) AS t, replace(p_name, 'ring', 'RING') AS r, instr(p_name, 'r') AS i FROM part")
sql_query(
    "sql_dates",
    "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM') AS month, cast(o_orderdate AS date) AS day, datediff(o_orderdate, timestamp '1992-01-01') AS days, year(o_orderdate) AS y FROM orders",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, cast(o_orderdate AS date) AS day, date_diff('day', timestamp '1992-01-01', o_orderdate) AS days, year(o_orderdate) AS y FROM orders",
)
sql_query("sql_having_offset", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5 ORDER BY n DESC, o_custkey LIMIT 20 OFFSET 10")
