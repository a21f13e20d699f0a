"""Profiling, catalogue, dictionary and value-index queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegate.operators import dictionary as dic
from valuegate.operators import gate
from valuegate.operators import index as ix
from valuegate.operators import profile as pf
from valuegate.operators import relational as rel
from valuegate.plans.registry import TABLES, Tables, query
from valuegate.sources.folders import laid_out
from valuegate.sources.local import local_rows

STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
#: Text columns of the given tables.
TEXTS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"], "pages": ["url", "html"], "benchmark": ["text"], "conversations": ["role", "text"],
}
#: Business terms for the given tables; the last two are wrong on purpose.
GLOSSARY = [
    ("segment", ["market segment", "segments"], ["customer.c_mktsegment"], "segments are upper case"),
    ("priority", ["order priority", "urgency"], ["orders.o_orderpriority"], None),
    ("part", ["part name", "product", "products"], ["part.p_name", "part.p_type"], "names have two words"),
    ("revenue", ["total price", "turnover"], ["orders.o_totalprice"], None),
    ("country", ["nation", "nations"], ["nation.n_name"], None),
    ("world_region", ["region", "continent"], ["region.r_name"], None),
    ("ghost", ["phantom"], [], None),
    ("colour", ["hue"], ["part.p_colour"], None),
]
GRAMMAR = "a, an, the, of, in, for, per, and, or, with, not, over, how, many, which, what, is, are, total, orders, order, customers, all, low"

_quote = lambda s: "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"
_list = lambda xs: "[" + ", ".join(map(_quote, xs)) + "]::varchar[]"
GLOSSARY_SQL = "glossary AS (SELECT * FROM (VALUES " + ", ".join(f"({_quote(a)}, {_list(b)}, {_list(c)}, {_quote(d)})" for a, b, c, d in GLOSSARY) + ") g(term, synonyms, columns, note))"
INVENTORY_SQL = (
    "inventory AS (SELECT table_name, column_name, CASE WHEN data_type IN ('INTEGER', 'BIGINT', 'SMALLINT', 'BOOLEAN') THEN 'INT' WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'REAL' ELSE 'TEXT' END AS compact_type, "
    "row_number() OVER (PARTITION BY table_name ORDER BY ordinal_position)::int AS ordinal FROM information_schema.columns WHERE table_name IN (" + ", ".join(map(_quote, TABLES)) + "))"
)
def _tier_sql(names: list[str], limit: int) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, (SELECT count(*) FROM {t}) AS n, count({c}) AS n_distinct, avg(length(trim({c}))) FILTER (trim({c}) <> '') AS mean FROM (SELECT DISTINCT {c} FROM {t})" for t in names for c in TEXTS.get(t, [])
    )
    return f"""SELECT table_name, column_name, CASE WHEN reason IS NULL THEN CASE WHEN n_distinct <= {limit} THEN 'A' ELSE 'B' END END AS tier, n_distinct,
      coalesce(reason, CASE WHEN n_distinct <= {limit} THEN 'bounded vocabulary' ELSE n_distinct || ' distinct: resolved on demand' END) AS reason FROM (
      SELECT *, CASE WHEN n_distinct < 2 THEN 'constant or empty' WHEN n_distinct > 200000 THEN '> 200000 distinct: not a vocabulary' WHEN n_distinct / n > 0.9 AND n_distinct > 100 THEN printf('near-unique (%.0f%%)', 100.0 * n_distinct / n)
      WHEN mean IS NULL THEN 'no usable value' WHEN mean < 2 THEN printf('values too short (%.1f chars)', mean) WHEN mean > 120 THEN printf('free text (%.0f chars)', mean) END AS reason FROM ({parts}))"""


def values_sql(name: str, tier: str, limit: int) -> str:
    """The distinct values of the columns of a tier, as common table expressions."""
    every = " UNION ALL ".join(f"SELECT DISTINCT trim({c}) AS value, '{t}.{c}' AS ref FROM {t} WHERE trim({c}) <> ''" for t, cs in TEXTS.items() for c in cs)
    return f"{name}_tiers AS MATERIALIZED (SELECT table_name || '.' || column_name AS ref FROM ({_tier_sql(TABLES, limit)}) WHERE tier = '{tier}'), {name} AS MATERIALIZED (SELECT value, ref FROM ({every}) JOIN {name}_tiers USING (ref))"


VALUES_SQL = values_sql("value_index", "A", 5000)
#: A strict limit on vocabularies, so that the given tables have columns that are resolved on demand.
STRICT = 50
TIER_B_SQL = values_sql("tier_b", "B", STRICT)
EXACT_SQL = f"{VALUES_SQL}, exact AS (SELECT DISTINCT lower(regexp_replace(trim(value), '\\s+', ' ', 'g')) AS value FROM value_index)"
_NORMAL_WORDS = "unnest(regexp_extract_all(lower({}), '[a-z0-9]+'))"
CONCEPTS_SQL = "concepts AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(phrase), '[a-z0-9]+')) AS word FROM (SELECT replace(term, '_', ' ') AS phrase FROM glossary UNION ALL SELECT unnest(synonyms) FROM glossary)) WHERE length(word) > 1)"
SCHEMA_WORDS_SQL = "schema_words AS (SELECT DISTINCT word FROM (SELECT name AS word FROM names UNION ALL SELECT unnest(string_split(name, '_')) FROM names) WHERE word <> '')"
NAMES_SQL = "names AS (SELECT lower(table_name) AS name FROM inventory UNION SELECT lower(column_name) FROM inventory)"
GRAMMAR_SQL = f"grammar AS (SELECT DISTINCT trim(w) AS word FROM (SELECT unnest(string_split({_quote(GRAMMAR)}, ',')) AS w) WHERE trim(w) <> '')"
TOKENS_SQL = f"""{values_sql('on_demand', 'B', 5000)}, value_tokens AS (SELECT DISTINCT unnest(regexp_extract_all(lower(value), '[a-zà-ÿ0-9]{{3,}}')) AS token FROM value_index WHERE len(regexp_extract_all(value, '[A-Za-zÀ-ÿ]+')) <= 3
  UNION SELECT DISTINCT unnest(regexp_extract_all(lower(value), '[a-zà-ÿ0-9]{{3,}}')) FROM on_demand)"""


def columns(t: Tables, names: list[str] | None = None) -> DataFrame:
    return pf.inventory(t.spark, t.all(names))


def glossary(t: Tables) -> DataFrame:
    return dic.terms(t.spark, GLOSSARY)


VALUE, TIER = "value string, ref string", "table_name string, column_name string, tier string, n_distinct long, reason string"


def index(t: Tables) -> DataFrame:
    """The tier-A values of all tables, kept as long as the tables stay as they are, by column."""
    return t.kept("value-index", VALUE, lambda: ix.build(t.all(), tiers(t)), ["ref"])


def tier_b(t: Tables) -> DataFrame:
    """The distinct values of columns that are resolved on demand, under the strict limit."""
    return t.kept("tier-b", VALUE, lambda: ix.build(t.all(), tiers(t, STRICT), "B"), ["ref"])


def tiers(t: Tables, limit: int = pf.VOCABULARY_LIMIT) -> DataFrame:
    return t.kept(f"column-tiers-{limit}", TIER, lambda: pf.column_tiers(t.all(), limit))


def on_demand_words(t: Tables) -> DataFrame:
    """Words of the columns that have too many values for the index: the gate knows them all the same."""
    return t.kept("tier-b-words", "word string", lambda: ix.words(ix.build(t.all(), tiers(t), "B")))


def value_words(t: Tables) -> DataFrame:
    return ix.value_tokens(index(t), on_demand_words(t))


def denylist(t: Tables) -> gate.Denylist:
    """What the gate holds texts against, kept like the index."""
    values = t.kept("denied-values", "value string, size int", lambda: gate.denied_values(ix.exact_values(index(t)), allowed(t)))
    tokens = t.kept("denied-tokens", "token string", lambda: gate.denied_tokens(value_words(t), allowed(t)))
    return gate.denylist(values, tokens, t.kept("denied-filters", gate.FILTERS, lambda: gate.filters(values, tokens)))


def grammar(t: Tables) -> DataFrame:
    return local_rows(t.spark, [(GRAMMAR,)], "line string").select(F.explode(dic.split_list(F.col("line"))).alias("word")).distinct()


@query("column_inventory", f"WITH {INVENTORY_SQL} SELECT * FROM inventory")
def column_inventory(t: Tables) -> DataFrame:
    return columns(t)


@query("ingest_report", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in STAR))
def ingest_report(t: Tables) -> DataFrame:
    from valuegate.sources.ingest import ingest

    return ingest({name: t(name).toDF(*(c.upper() for c in t(name).columns)) for name in STAR})


_KEYS = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey")]
_CANDIDATES = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"]}
KEYS_SQL = "found AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, coalesce(" + ", ".join(f"CASE WHEN count(DISTINCT {c}) = count(*) THEN '{c}' END" for c in cs) + f", NULL) AS key_column FROM {t}" for t, cs in _CANDIDATES.items()) + ")"
FKS_SQL = f"{INVENTORY_SQL}, {KEYS_SQL}, links AS (SELECT i.table_name, i.column_name, f.table_name AS ref_table, f.key_column AS ref_column FROM inventory i JOIN found f ON regexp_replace(i.column_name, '^[a-z]{{1,2}}_', '') = regexp_replace(f.key_column, '^[a-z]{{1,2}}_', '') AND i.table_name <> f.table_name WHERE i.table_name IN ({', '.join(map(_quote, STAR))}))"


@query("key_inference", f"WITH {KEYS_SQL} SELECT * FROM found")
def key_inference(t: Tables) -> DataFrame:
    return pf.keys(t.all(STAR))


def _links(t: Tables) -> DataFrame:
    return pf.foreign_keys(columns(t, STAR), key_inference(t))


@query("fk_inference", f"WITH {FKS_SQL} SELECT * FROM links")
def fk_inference(t: Tables) -> DataFrame:
    return _links(t)


@query(
    "schema_summary",
    f"WITH {FKS_SQL}, counts AS (" + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in TABLES) + ") SELECT table_name, n_rows, count(*) AS n_columns, (SELECT count(*) FROM links l WHERE l.table_name = counts.table_name) AS n_links FROM counts JOIN inventory USING (table_name) GROUP BY ALL",
)
def schema_summary(t: Tables) -> DataFrame:
    sizes = columns(t).groupBy("table_name").agg(F.count("*").alias("n_columns"))
    links = _links(t).groupBy("table_name").agg(F.count("*").alias("n_links"))
    return rel.row_counts(t.all()).join(sizes, "table_name").join(links, "table_name", "left").select("table_name", "n_rows", "n_columns", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query("key_columns", f"WITH {FKS_SQL} SELECT table_name, key_column AS column_name FROM found WHERE key_column IS NOT NULL UNION SELECT table_name, column_name FROM links UNION SELECT ref_table, ref_column FROM links")
def key_columns(t: Tables) -> DataFrame:
    return pf.key_columns(key_inference(t), _links(t))


@query("join_key_layout", "SELECT o_orderpriority, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def join_key_layout(t: Tables) -> DataFrame:
    """Both ends of an inferred link laid out by it and joined without a shuffle."""
    buckets = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    orders = laid_out(t("orders").select("o_orderkey", "o_orderpriority"), "orders", ["o_orderkey"], buckets)
    lines = laid_out(t("lineitem").select("l_orderkey"), "lines", ["l_orderkey"], buckets)
    met = orders.join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    each = met.groupBy("o_orderkey", "o_orderpriority").agg(F.count("*").alias("n"))  # on the key still: no shuffle either
    return each.groupBy("o_orderpriority").agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_orders"))


@query("column_tiers", _tier_sql(TABLES, 5000))
def column_tiers(t: Tables) -> DataFrame:
    return tiers(t)


@query("column_tiers_strict", _tier_sql(TABLES, STRICT))
def column_tiers_strict(t: Tables) -> DataFrame:
    return tiers(t, STRICT)


@query("value_index_build", f"WITH {VALUES_SQL} SELECT * FROM value_index")
def value_index_build(t: Tables) -> DataFrame:
    from valuegate.sources.folders import new_folder

    folder = new_folder(t.spark, "value-index")
    ix.write(ix.build(t.all(), tiers(t)), folder)
    return t.spark.read.parquet(folder).select("value", "ref")


@query("index_stats", f"WITH {VALUES_SQL}, tiers AS ({_tier_sql(TABLES, 5000)}) SELECT 'tier ' || coalesce(tier, 'none') AS measure, count(*) AS n FROM tiers GROUP BY tier UNION ALL SELECT 'values', count(*) FROM value_index")
def index_stats(t: Tables) -> DataFrame:
    return ix.stats(tiers(t), index(t))


@query("exact_values", f"WITH {EXACT_SQL} SELECT value FROM exact")
def exact_values(t: Tables) -> DataFrame:
    return ix.exact_values(index(t))


@query("value_tokens", f"WITH {VALUES_SQL}, {TOKENS_SQL} SELECT token FROM value_tokens")
def value_tokens(t: Tables) -> DataFrame:
    return value_words(t)


_STRICT_TOKENS = "SELECT DISTINCT unnest(regexp_extract_all(lower(value), '[a-zà-ÿ0-9]{3,}')) AS token FROM value_index WHERE len(regexp_extract_all(value, '[A-Za-zÀ-ÿ]+')) <= 3"
_WORDS_B = "SELECT DISTINCT unnest(regexp_extract_all(lower(value), '[a-zà-ÿ0-9]{3,}')) AS word FROM tier_b"


@query("tier_b_words", f"WITH {TIER_B_SQL} {_WORDS_B}")
def tier_b_words(t: Tables) -> DataFrame:
    return ix.words(tier_b(t))


@query("value_tokens_strict", f"WITH {values_sql('value_index', 'A', STRICT)}, {TIER_B_SQL} SELECT token FROM ({_STRICT_TOKENS}) UNION SELECT word FROM ({_WORDS_B})")
def value_tokens_strict(t: Tables) -> DataFrame:
    return ix.value_tokens(ix.build(t.all(), tiers(t, STRICT)), tier_b_words(t))


@query("index_meta", f"WITH {VALUES_SQL}, t AS ({_tier_sql(TABLES, 5000)}) SELECT t.table_name, t.column_name, tier, n_distinct, reason, count(value) AS n_indexed FROM t LEFT JOIN value_index v ON v.ref = t.table_name || '.' || t.column_name GROUP BY ALL")
def index_meta(t: Tables) -> DataFrame:
    return ix.report(tiers(t), index(t))


@query("index_report", f"WITH {VALUES_SQL}, t AS ({_tier_sql(TABLES, 5000)}) SELECT t.table_name, t.column_name, tier, n_distinct, reason, count(value) AS n_indexed FROM t LEFT JOIN value_index v ON v.ref = t.table_name || '.' || t.column_name GROUP BY ALL")
def index_report(t: Tables) -> DataFrame:
    """The columns' report as JSON lines, written and read again."""
    from valuegate.sources.folders import new_folder

    folder, rows = new_folder(t.spark, "index-report"), ix.report(tiers(t), index(t))
    rows.coalesce(1).write.json(folder)  # a row a column
    return t.spark.read.schema(rows.schema).json(folder)


@query("longest_value_words", f"WITH {EXACT_SQL} SELECT least(greatest(max(len(string_split(value, ' '))), 6), 32)::int AS n_words FROM exact")
def longest_value_words(t: Tables) -> DataFrame:
    return ix.longest_value_words(ix.exact_values(index(t)))


@query("carries_information", "SELECT o_orderpriority AS value, length(trim(o_orderpriority)) >= 3 AND regexp_matches(o_orderpriority, '\\p{L}') AS informs FROM (SELECT DISTINCT o_orderpriority FROM orders UNION SELECT DISTINCT l_returnflag FROM lineitem UNION SELECT o_orderkey::varchar FROM orders)")
def carries_information(t: Tables) -> DataFrame:
    values = t("orders").select(F.col("o_orderpriority").alias("value")).union(t("lineitem").select("l_returnflag")).union(t("orders").select(F.col("o_orderkey").cast("string"))).distinct()
    return values.select("value", ix.carries_information(F.col("value")).alias("informs"))


_BITS, _HASHES = ix.bloom_size(2000)
_DIGEST = "('0x' || substr(sha256({0}), 1, 8))::bigint AS h1, ('0x' || substr(sha256({0}), 9, 8))::bigint | 1 AS h2"
BLOOM_SQL = f"{VALUES_SQL}, {TOKENS_SQL}, positions AS (SELECT token, (h1 + i * h2) % {_BITS} AS p FROM (SELECT token, {_DIGEST.format('token')} FROM value_tokens), range({_HASHES}) r(i)), filter_bytes AS (SELECT p // 8 AS byte, bit_or((1 << (p % 8)::int)::int) AS bits FROM positions GROUP BY 1)"


@query("bloom_build", f"WITH {BLOOM_SQL} SELECT * FROM filter_bytes")
def bloom_build(t: Tables) -> DataFrame:
    return ix.bloom(value_words(t), "token", _BITS, _HASHES)


@query(
    "bloom_probe",
    f"""WITH {BLOOM_SQL}, items AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS word FROM benchmark UNION SELECT DISTINCT lower(c_mktsegment) FROM customer),
    probes AS (SELECT word, (h1 + i * h2) % {_BITS} AS p FROM (SELECT word, {_DIGEST.format('word')} FROM items), range({_HASHES}) r(i))
    SELECT word, bool_and((coalesce(bits, 0) & (1 << (p % 8)::int)::int) <> 0) AS present FROM probes LEFT JOIN filter_bytes ON byte = p // 8 GROUP BY word""",
)
def bloom_probe(t: Tables) -> DataFrame:
    words = t("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word")).union(t("customer").select(F.lower("c_mktsegment")))
    return ix.probe(words, "word", ix.bloom(value_words(t), "token", _BITS, _HASHES), _BITS, _HASHES)


_HEADS_SQL = f"""{INVENTORY_SQL}, ends AS (SELECT right(lower(column_name), k::int) AS word FROM inventory, range(3, 11) r(k) WHERE k <= length(column_name)),
    counted AS (SELECT word, count(*) AS n FROM ends GROUP BY word HAVING count(*) >= 3 AND word NOT IN (SELECT lower(table_name) FROM inventory)),
    heads AS (SELECT * FROM counted c WHERE NOT EXISTS (SELECT 1 FROM counted o WHERE o.word <> c.word AND o.n = c.n AND ends_with(o.word, c.word)))"""


@query("head_words", f"WITH {_HEADS_SQL} SELECT word, n FROM heads")
def head_words(t: Tables) -> DataFrame:
    return pf.head_words(columns(t))


MENTIONS = "SELECT DISTINCT concat(p_name, CASE WHEN p_size % 3 = 0 THEN ' names' WHEN p_size % 3 = 1 THEN ' keys' ELSE ' boxes' END) AS mention FROM part"


@query("names_a_column", f"WITH {_HEADS_SQL}, m AS ({MENTIONS}), s AS (SELECT mention, CASE WHEN mention LIKE '%boxes' THEN 'box' ELSE regexp_extract(mention, '([a-z]+)s$', 1) END AS head FROM m) SELECT mention, head FROM s WHERE head IN (SELECT word FROM heads)")
def names_a_column(t: Tables) -> DataFrame:
    return pf.names_a_column(t.sql(MENTIONS), head_words(t))


_NAMED_COLUMNS = sorted({c for _, _, cs, _ in GLOSSARY for c in cs} - {"part.p_colour"})


@query("glossary_integrity", f"WITH {INVENTORY_SQL}, {GLOSSARY_SQL} SELECT term, 'no column declared' AS problem FROM glossary WHERE len(columns) = 0 UNION ALL SELECT term, ref || ': unknown column' FROM (SELECT term, unnest(columns) AS ref FROM glossary) WHERE ref NOT IN (SELECT table_name || '.' || column_name FROM inventory) UNION ALL SELECT term, ref || ': no value' FROM (SELECT term, unnest(columns) AS ref FROM glossary) JOIN (" + " UNION ALL ".join(f"SELECT '{r}' AS ref, count({r.split('.')[1]}) FILTER ({r.split('.')[1]} IS NOT NULL) AS n FROM {r.split('.')[0]}" for r in _NAMED_COLUMNS) + ") USING (ref) WHERE n = 0")
def glossary_integrity(t: Tables) -> DataFrame:
    used = {r["ref"] for r in glossary(t).select(F.explode("columns").alias("ref")).distinct().collect()}  # the dictionary's references
    known = {f"{name}.{c}" for name, frame in t.all().items() for c in frame.columns}
    return dic.integrity(glossary(t), columns(t), dic.filled({r: t(r.split(".")[0]) for r in sorted(used & known)}))


_CARDS_SQL = f"""{INVENTORY_SQL}, {GLOSSARY_SQL}, {VALUES_SQL}, phrases AS (SELECT term, replace(term, '_', ' ') AS phrase FROM glossary UNION SELECT term, unnest(synonyms) FROM glossary),
    known AS (SELECT ref, list_sort(list(DISTINCT phrase)) AS synonyms FROM phrases JOIN (SELECT term, unnest(columns) AS ref FROM glossary) USING (term) GROUP BY ref),
    cards AS (SELECT i.table_name || '.' || i.column_name AS ref, i.table_name, i.column_name, coalesce(synonyms, []::varchar[]) AS synonyms FROM inventory i LEFT JOIN known k ON k.ref = i.table_name || '.' || i.column_name
    WHERE k.ref IS NOT NULL OR NOT (regexp_matches(lower(column_name), '(id|key|offset)$') OR (compact_type = 'TEXT' AND i.table_name || '.' || i.column_name NOT IN (SELECT ref FROM value_index))))"""


@query("column_cards", f"WITH {_CARDS_SQL} SELECT ref, table_name, column_name, array_to_string(synonyms, '|') AS synonyms FROM cards")
def column_cards(t: Tables) -> DataFrame:
    return cards(t).withColumn("synonyms", F.array_join("synonyms", "|"))


def cards(t: Tables) -> DataFrame:
    return dic.cards(columns(t), index(t).select("ref").distinct(), glossary(t))


@query("dictionary_load", f"WITH {GRAMMAR_SQL}, segments AS (SELECT DISTINCT lower(c_mktsegment) AS word FROM customer) SELECT word, word IN (SELECT word FROM segments) AS stored FROM (SELECT word FROM grammar UNION SELECT word FROM segments)")
def dictionary_load(t: Tables) -> DataFrame:
    stored = t("customer").select(F.lower("c_mktsegment").alias("word")).distinct()
    return grammar(t).union(stored).distinct().join(stored.withColumn("s", F.lit(True)), "word", "left").select("word", F.coalesce("s", F.lit(False)).alias("stored"))


ALLOWED_SQL = f"{INVENTORY_SQL}, {NAMES_SQL}, {SCHEMA_WORDS_SQL}, {GLOSSARY_SQL}, {CONCEPTS_SQL}, {GRAMMAR_SQL}, allowed AS (SELECT word, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT word, 'schema' AS source FROM schema_words UNION SELECT word, 'glossary' FROM concepts UNION SELECT word, 'grammar' FROM grammar) GROUP BY word)"


def allowed(t: Tables) -> DataFrame:
    return dic.allowlist({"schema": dic.schema_words(columns(t)), "glossary": dic.concept_words(glossary(t)), "grammar": grammar(t)})


@query("allowlist_build", f"WITH {ALLOWED_SQL}, {VALUES_SQL}, {TOKENS_SQL} SELECT word, sources, word IN (SELECT token FROM value_tokens) AS stored FROM allowed")
def allowlist_build(t: Tables) -> DataFrame:
    """Every allowed word, its sources, and whether stored values hold it, which the gate then lets pass."""
    tokens = value_words(t).select(F.col("token").alias("word"), F.lit(True).alias("stored"))
    return allowed(t).join(tokens, "word", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


@query("vocabulary_stats", f"WITH {ALLOWED_SQL}, {VALUES_SQL}, {TOKENS_SQL} SELECT 'columns' AS measure, count(*) AS n FROM inventory UNION ALL SELECT 'terms', count(*) FROM glossary UNION ALL SELECT 'allowed words', count(*) FROM allowed UNION ALL SELECT 'values', count(*) FROM value_index UNION ALL SELECT 'value tokens', count(*) FROM value_tokens")
def vocabulary_stats(t: Tables) -> DataFrame:
    values = index(t)
    frames = {"columns": columns(t), "terms": glossary(t), "allowed words": allowed(t), "values": values, "value tokens": value_words(t)}
    return rel.row_counts(frames).select(F.col("table_name").alias("measure"), F.col("n_rows").alias("n"))


_NAMED = "SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 2 = 0 THEN 'orders' ELSE 'customer' END AS table_name FROM orders UNION SELECT o_orderkey, 'lineitem' FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT o_orderkey, 'nation' FROM orders"


@query("table_scope", f"WITH named AS ({_NAMED}), counts AS (" + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in STAR) + ") SELECT doc, table_name FROM named JOIN counts USING (table_name) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n_rows, table_name) <= 2")
def table_scope(t: Tables) -> DataFrame:
    return pf.table_scope(t.sql(_NAMED), rel.row_counts(t.all(STAR)), 2)


@query("table_scope_hub", f"WITH named AS (SELECT * FROM ({_NAMED}) WHERE doc % 4 <> 0 UNION SELECT o_orderkey, 'nowhere' FROM orders WHERE o_orderkey % 4 = 0), known AS (SELECT * FROM named WHERE table_name IN ({', '.join(map(_quote, STAR))}) UNION SELECT DISTINCT doc, 'part' FROM named), counts AS (" + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in STAR) + ") SELECT doc, table_name FROM known JOIN counts USING (table_name) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n_rows, table_name) <= 2")
def table_scope_hub(t: Tables) -> DataFrame:
    named = t.sql(_NAMED).filter("doc % 4 <> 0").unionAll(t.sql("SELECT o_orderkey, 'nowhere' FROM orders WHERE o_orderkey % 4 = 0"))
    return pf.table_scope(named, rel.row_counts(t.all(STAR)), 2, hub="part")


@query(
    "column_scope",
    f"""WITH {FKS_SQL}, keyed AS (SELECT table_name, key_column AS column_name FROM found WHERE key_column IS NOT NULL UNION SELECT table_name, column_name FROM links UNION SELECT ref_table, ref_column FROM links),
    r AS (SELECT o_orderkey AS doc, 'orders' AS table_name, 'o_orderpriority' AS column_name FROM orders UNION SELECT o_orderkey, 'customer', 'c_segment' FROM orders WHERE o_orderkey % 2 = 0)
    SELECT doc, table_name, column_name FROM r SEMI JOIN inventory USING (table_name, column_name) UNION SELECT doc, table_name, k.column_name FROM r JOIN keyed k USING (table_name)""",
)
def column_scope(t: Tables) -> DataFrame:
    resolved = t.sql("SELECT o_orderkey AS doc, 'orders' AS table_name, 'o_orderpriority' AS column_name FROM orders UNION SELECT o_orderkey, 'customer', 'c_segment' FROM orders WHERE o_orderkey % 2 = 0")
    return pf.column_scope(resolved, key_columns(t), columns(t))
