"""Search and linking queries over mentions made from ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegate.functions import text as tx
from valuegate.operators import search as se
from valuegate.operators import gate
from valuegate.plans import profiling as pr
from valuegate.plans.registry import Tables, query

MENTIONS = "SELECT DISTINCT mention FROM (SELECT p_name AS mention FROM part UNION ALL SELECT substr(p_name, 1, instr(p_name, ' ') - 1) FROM part UNION ALL SELECT concat(substr(p_name, 1, 3), substr(p_name, 5)) FROM part UNION ALL SELECT concat(lower(p_brand), ' ', p_type) FROM part) m"
LINKED = "SELECT DISTINCT mention FROM (SELECT 'market segment' AS mention FROM customer UNION ALL SELECT concat('order priority ', p_size % 3) FROM part UNION ALL SELECT concat('part ', substr(p_name, instr(p_name, ' ') + 1), ' keys') FROM part UNION ALL SELECT 'retail price' FROM part) m"


def mentions(t: Tables) -> DataFrame:
    return t.sql(MENTIONS)


_TOKS = "SELECT DISTINCT {0}, token FROM (SELECT {0}, unnest(regexp_extract_all(lower({1}), '[a-z0-9]+')) AS token FROM {2}) WHERE length(token) > 1"


@query("search_prefix", f"WITH {pr.VALUES_SQL}, m AS ({MENTIONS}), a AS ({_TOKS.format('mention', 'mention', 'm')}), b AS ({_TOKS.format('value, ref', 'value', 'value_index')}) SELECT mention, value, ref, n_tokens::int AS n_tokens, count(DISTINCT a.token) AS matched FROM a JOIN (SELECT mention, count(*) AS n_tokens FROM a GROUP BY mention) USING (mention) JOIN b ON starts_with(b.token, a.token) GROUP BY ALL")
def search_prefix(t: Tables) -> DataFrame:
    return se.prefix_candidates(mentions(t), pr.index(t))


@query("search_contains", f"WITH {pr.VALUES_SQL}, m AS ({MENTIONS}) SELECT DISTINCT mention, value, ref FROM m, value_index WHERE contains(lower(value), lower(mention))")
def search_contains(t: Tables) -> DataFrame:
    return se.search_contains(mentions(t), pr.index(t))


@query("search_fuzzy")
def search_fuzzy(t: Tables) -> DataFrame:
    return se.search_fuzzy(mentions(t), pr.index(t))


@query("value_search")
def value_search(t: Tables) -> DataFrame:
    return se.value_search(mentions(t), pr.index(t), pr.tier_b(t))


_PIECES = "SELECT DISTINCT mention FROM (SELECT substr(p_name, 2, 6) AS mention FROM part UNION ALL SELECT upper(substr(p_name, 4)) FROM part UNION ALL SELECT c_mktsegment FROM customer) m"


@query("search_on_demand", f"WITH {pr.TIER_B_SQL}, m AS ({_PIECES}) SELECT DISTINCT mention, value, ref FROM m, tier_b WHERE contains(lower(value), lower(trim(mention)))")
def search_on_demand(t: Tables) -> DataFrame:
    return se.search_contains(t.sql(_PIECES), pr.tier_b(t))


_FOUND = "SELECT DISTINCT p_type AS mention, p_name AS value, concat('part.c', p_size % 7) AS ref, round((p_size % 10) / 10.0, 1) AS score FROM part"
_ORDER = "score DESC, coalesce(position, 1048576), length(value), value, ref"


@query("search_rank", f"WITH f AS ({_FOUND}), s AS (SELECT *, CASE WHEN ref = 'part.c3' THEN 1 WHEN ref = 'part.c5' THEN 0 END AS position FROM f), o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY mention, ref ORDER BY {_ORDER}) = 1) SELECT mention, value, ref, score::double AS score, row_number() OVER (PARTITION BY mention ORDER BY {_ORDER}) AS place FROM o QUALIFY place <= 5")
def search_rank(t: Tables) -> DataFrame:
    found = t.sql(_FOUND).withColumn("score", F.col("score").cast("double"))
    scope = found.select("mention").distinct().withColumn("s", F.explode(F.array(F.struct(F.lit("part.c5").alias("ref"), F.lit(0).alias("position")), F.struct(F.lit("part.c3").alias("ref"), F.lit(1).alias("position"))))).select("mention", "s.*")
    return se.rank(found, scope)


_LETTERS = "[a-zà-öø-ÿ]+"
_BM = f"SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '{_LETTERS}')) AS token FROM documents"
_BQ = f"SELECT item_id AS query, unnest(regexp_extract_all(lower(text), '{_LETTERS}')) AS token FROM benchmark"


@query("bm25_topk", f"""WITH d AS ({_BM}), q AS (SELECT DISTINCT * FROM ({_BQ})), tf AS (SELECT doc, token, count(*) AS tf FROM d GROUP BY ALL), dl AS (SELECT doc, count(*) AS dl FROM d GROUP BY doc), w AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token)
    SELECT query, doc, score FROM (SELECT query, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN df USING (token) JOIN tf USING (token) JOIN dl USING (doc), w GROUP BY query, doc) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 10""")
def bm25_topk(t: Tables) -> DataFrame:
    words = lambda c: tx.find_all(F.lower(c), _LETTERS)
    docs = t("documents").select(F.col("doc_id").alias("doc"), F.explode(words("text")).alias("token"))
    asked = t("benchmark").select(F.col("item_id").alias("query"), F.explode(words("text")).alias("token"))
    return se.bm25(asked, docs, 10)


_GRAMS = "SELECT {0}, substr(p, i::int, 3) AS gram, count(*) AS n FROM (SELECT {0}, '  ' || array_to_string(regexp_extract_all(lower({1}), '[a-z0-9]+'), ' ') || '  ' AS p FROM {2}), range(1, 80) r(i) WHERE i <= length(p) - 2 GROUP BY ALL"
_COS = "SELECT a.mention, {0}, sum(a.n * b.n) / (any_value(na) * any_value(nb)) AS cos FROM ma a JOIN {1} b USING (gram) JOIN (SELECT mention, sqrt(sum(n * n)) AS na FROM ma GROUP BY mention) USING (mention) JOIN (SELECT {0}, sqrt(sum(n * n)) AS nb FROM {1} GROUP BY ALL) USING ({0}) GROUP BY a.mention, {0}"


@query("column_link", f"""WITH {pr._CARDS_SQL}, ends AS{pr._HEADS_SQL.split(', ends AS', 1)[1]}, m AS ({LINKED}), ma AS ({_GRAMS.format('mention', 'mention', 'm')}),
    g1 AS ({_GRAMS.format('ref', "table_name || ' ' || column_name", 'cards')}), g2 AS ({_GRAMS.format('ref', 'column_name', 'cards')}), syn AS (SELECT ref, unnest(synonyms) AS synonym FROM cards), g3 AS ({_GRAMS.format('ref, synonym', 'synonym', 'syn')}),
    c1 AS ({_COS.format('ref', 'g1')}), c2 AS ({_COS.format('ref', 'g2')}), c3 AS (SELECT mention, ref, 0.6 * max(cos) AS cos FROM ({_COS.format('ref, synonym', 'g3')}) GROUP BY ALL),
    s AS (SELECT mention, ref, 0.75 * greatest(coalesce(c1.cos, 0), coalesce(c3.cos, 0)) + 0.25 * coalesce(c2.cos, 0) AS base FROM c1 FULL JOIN c2 USING (mention, ref) FULL JOIN c3 USING (mention, ref)),
    h AS (SELECT s.*, table_name, column_name, synonyms, regexp_extract_all(mention, '[a-z0-9]+') AS ws, CASE WHEN mention LIKE '%s' THEN regexp_extract(mention, '([a-z]+)s$', 1) ELSE regexp_extract(mention, '([a-z0-9]+)$', 1) END AS head FROM s JOIN cards USING (ref)),
    f AS (SELECT mention, ref, round(CASE WHEN list_contains(synonyms, mention) THEN 1.0 WHEN head IN (SELECT word FROM heads) AND contains(column_name, head) AND len(list_filter(ws[1:len(ws) - 1], lambda w: length(w) > 3 AND (contains(table_name, w) OR contains(column_name, w)))) > 0 THEN greatest(base, 0.9) ELSE base END, 4) AS score FROM h)
    SELECT mention, ref, score FROM f WHERE score >= 0.25 QUALIFY row_number() OVER (PARTITION BY mention ORDER BY score DESC, length(ref), ref) <= 4""")
def column_link(t: Tables) -> DataFrame:
    return se.link_columns(t.sql(LINKED), pr.cards(t), pr.head_words(t))


@query("nearest_examples")
def nearest_examples(t: Tables) -> DataFrame:
    texts = t("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("How many parts of size "), F.col("p_size").cast("string"), F.lit(" are called "), "p_name").alias("text"))
    examples = t("part").select(F.concat(F.lit("How many parts of size "), (F.col("p_size") % 9).cast("string"), F.lit(" of type "), F.lower("p_type")).alias("example")).union(t("customer").select(F.concat(F.lit("List customers in "), "c_mktsegment"))).distinct()
    leaked = gate.known_values(examples.select(F.col("example").alias("id"), F.col("example").alias("text")), pr.denylist(t)).select(F.col("id").alias("example"))
    return se.nearest_examples(texts, examples, leaked)
