"""Text functions, tagging, masking and pseudonym queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegate.functions import text as tx
from valuegate.operators import masking as mk
from valuegate.operators import tagging as tg
from valuegate.plans import profiling as pr
from valuegate.plans.gate_plans import MESSAGES
from valuegate.plans.registry import Tables, query

GENERIC = sorted({w.strip() for w in pr.GRAMMAR.split(",")})
_GENERIC_SQL = "[" + ", ".join(f"'{w}'" for w in GENERIC) + "]"
_generic = lambda: F.array(*map(F.lit, GENERIC))
_lit = lambda s: "'" + s.replace("'", "''") + "'"

# Functions


@query("fn_normalize", "SELECT doc_id, md5(strip_accents(lower(text))) AS folded FROM documents")
def fn_normalize(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.md5(tx.normalize(F.col("text"))).alias("folded"))


@query("fn_tokenise", "SELECT item_id, generate_subscripts(ts, 1) - 1 AS place, unnest(ts) AS token FROM (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[a-z0-9&]+') AS ts FROM benchmark)")
def fn_tokenise(t: Tables) -> DataFrame:
    return t("benchmark").select("item_id", F.posexplode(tx.tokens(F.col("text"))).alias("place", "token"))


_CELL = "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat(p_name, ' | ', p_brand, '/', p_type, ';', p_name, ' : ab') ELSE p_name END AS cell FROM part"


@query("fn_parts", f"WITH c AS ({_CELL}), k AS (SELECT *, list_filter(regexp_split_to_array(cell, '\\s*[|/;:]\\s*'), lambda p: length(trim(p)) > 3) AS cut FROM c) SELECT p_partkey, array_to_string(CASE WHEN length(cell) > 32 AND len(cut) > 1 THEN list_concat([cell], cut[1:6]) ELSE [cell] END, '#') AS parts FROM k")
def fn_parts(t: Tables) -> DataFrame:
    return t.sql(_CELL).select("p_partkey", F.array_join(tx.parts(F.col("cell")), "#").alias("parts"))


@query("fn_trigrams", "SELECT p_partkey, substr(padded, i::int, 3) AS gram, count(*) AS n FROM (SELECT p_partkey, '  ' || array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ' ') || '  ' AS padded FROM part), range(1, 60) r(i) WHERE i <= length(padded) - 2 GROUP BY ALL")
def fn_trigrams(t: Tables) -> DataFrame:
    # Counted where a key's names stand: only names are shuffled and held, not their pieces.
    named = t("part").select("p_partkey", "p_name").repartition("p_partkey").groupBy("p_partkey").agg(F.collect_list("p_name").alias("names"))
    pieces = F.flatten(F.transform("names", tx.trigrams))
    return named.select("p_partkey", F.explode(tx.counted(pieces)).alias("c")).select("p_partkey", F.col("c.item").alias("gram"), "c.n")


_AMOUNTS = "SELECT o_orderkey, concat('pay ', cast(cast(floor(o_totalprice) AS bigint) AS string), ' or ', o_custkey, ',5 in x12 and ', o_orderpriority) AS text FROM orders"


@query("fn_numbers", f"WITH a AS ({_AMOUNTS}) SELECT o_orderkey, array_to_string(list_transform(regexp_extract_all(' ' || text, '[^\\w.](\\d+(?:[.,]\\d+)?)', 1), lambda w: w), '|') AS numbers, try_cast(replace(regexp_extract(text, 'or (\\S+)', 1), ',', '.') AS double) AS value FROM a")
def fn_numbers(t: Tables) -> DataFrame:
    return t.sql(_AMOUNTS).select("o_orderkey", F.array_join(tx.numbers(F.col("text")), "|").alias("numbers"), tx.as_number(F.regexp_extract("text", r"or (\S+)", 1)).alias("value"))


_FIRST = "SELECT p_partkey, concat('a ', p_name, 'er, ', upper(p_name), ' and ', p_name) AS text, p_name, CASE WHEN p_size % 2 = 0 THEN p_name ELSE substr(p_name, 2) END AS mention FROM part"


@query("fn_replace_first", f"WITH f AS ({_FIRST}) SELECT p_partkey, CASE WHEN regexp_matches(text, '(?i)\\b' || mention || '\\b') THEN regexp_replace(text, '(?i)\\b' || mention || '\\b', ':v1') ELSE regexp_replace(text, '(?i)' || mention, ':v1') END AS text FROM f")
def fn_replace_first(t: Tables) -> DataFrame:
    return t.sql(_FIRST).select("p_partkey", tx.replace_first(F.col("text"), F.col("mention"), F.lit(":v1")).alias("text"))


@query("fn_fingerprint", "SELECT doc_id, sha256(text) AS digest, substr(sha256(text), 1, 16) AS short FROM documents")
def fn_fingerprint(t: Tables) -> DataFrame:
    digest = F.sha2("text", 256)
    return t("documents").select("doc_id", digest.alias("digest"), F.substring(digest, 1, 16).alias("short"))


_REPLY = """SELECT o_orderkey, o_orderkey % 5 AS kind, o_custkey AS k, CASE o_orderkey % 5 WHEN 0 THEN concat('<think>SELECT 1</think> Sure: ```sql\nSELECT * FROM orders WHERE o_custkey = ', o_custkey, ';\n``` done')
  WHEN 1 THEN concat('with x as (select ', o_custkey, ') select * from x ;') WHEN 2 THEN 'I cannot answer that.' WHEN 3 THEN concat('Here it is\n  SELECT ', o_custkey, '\n') ELSE 'WITH nothing' END AS reply FROM orders"""


@query("fn_extract_sql", f"WITH r AS ({_REPLY.replace(chr(10) + 'SELECT', chr(10) + 'SELECT')}) SELECT o_orderkey, CASE kind WHEN 0 THEN 'SELECT * FROM orders WHERE o_custkey = ' || k WHEN 1 THEN 'with x as (select ' || k || ') select * from x' WHEN 3 THEN 'SELECT ' || k ELSE '' END AS sql FROM r")
def fn_extract_sql(t: Tables) -> DataFrame:
    return t.sql(_REPLY).select("o_orderkey", tx.extract_sql(F.col("reply")).alias("sql"))


@query("fn_perplexity", "SELECT user_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE round(exp(-sum(-value / 100) / count(*)), 4) END AS perplexity FROM events GROUP BY user_id")
def fn_perplexity(t: Tables) -> DataFrame:
    logs = t("events").groupBy("user_id").agg(F.collect_list(F.when(F.col("user_id") % 10 != 0, -F.col("value") / 100)).alias("p"))
    return logs.select("user_id", tx.perplexity(F.col("p")).alias("perplexity"))


_HARD = " + ".join(f"contains(lower(text), {_lit(w)})::int" for w in tx.HARD_WORDS)


@query("fn_difficulty", f"WITH m AS ({MESSAGES}), s AS (SELECT id, round(least(0.25 * least((id % 6) / 4.0, 1) + 0.25 * least((id % 4) / 3.0, 1) + 0.5 * least(({_HARD}) / 3.0, 1), 1), 3)::double AS difficulty FROM m) SELECT id, difficulty, CASE WHEN difficulty < 0.35 THEN 'small' WHEN difficulty < 0.7 THEN 'medium' ELSE 'large' END AS rung FROM s")
def fn_difficulty(t: Tables) -> DataFrame:
    score = tx.difficulty(F.col("text"), F.col("id") % 6, F.col("id") % 4)
    return t.sql(MESSAGES).select("id", score.alias("difficulty"), tx.rung(score).alias("rung"))


_SPANS = "SELECT p_partkey, concat('the ', p_name, ' of ', lower(p_type)) AS mention FROM part"


@query(
    "fn_subspans",
    f"""WITH m AS (SELECT p_partkey, string_split(mention, ' ') AS ws FROM ({_SPANS})), s AS (SELECT p_partkey, size, start, ws[start:start + size - 1] AS span FROM m, range(1, 10) a(size), range(1, 10) b(start) WHERE size < len(ws) AND start + size - 1 <= len(ws)),
    k AS (SELECT p_partkey, size, start, array_to_string(span, ' ') AS span FROM s WHERE len(list_filter(span, lambda w: NOT list_contains({_GENERIC_SQL}, w))) > 0)
    SELECT p_partkey, string_agg(span, '|' ORDER BY size DESC, start) AS spans FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY size DESC, start) <= 6) GROUP BY p_partkey""",
)
def fn_subspans(t: Tables) -> DataFrame:
    return t.sql(_SPANS).select("p_partkey", F.array_join(tx.subspans(F.col("mention"), _generic()), "|").alias("spans"))


_SHAPES = "SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN concat('dr ', lower(c_mktsegment)) WHEN 1 THEN c_mktsegment WHEN 2 THEN lower(c_mktsegment) ELSE concat('How ', lower(c_mktsegment)) END AS mention FROM customer"


@query("fn_name_shape", f"WITH s AS ({_SHAPES}) SELECT mention, regexp_matches(mention, '(?i)^(mr|mrs|ms|miss|dr|prof|sir|m|mme|mlle)\\b') OR len(list_filter(regexp_extract_all(mention, '[A-Za-z]+'), lambda w: regexp_matches(w, '^[A-Z]') AND NOT list_contains({_GENERIC_SQL}, lower(w)))) > 0 AS named FROM s")
def fn_name_shape(t: Tables) -> DataFrame:
    return t.sql(_SHAPES).select("mention", tx.name_shaped(F.col("mention"), _generic()).alias("named"))


_KINDS = """SELECT DISTINCT CASE p_size % 6 WHEN 0 THEN p_name WHEN 1 THEN 'market segment' WHEN 2 THEN cast(p_size AS string) WHEN 3 THEN concat(p_name, ' keys') WHEN 4 THEN lower(p_brand) ELSE concat('Dr ', p_name) END AS mention,
  CASE WHEN p_size % 6 = 5 THEN 'person' ELSE 'part' END AS type, p_size % 6 AS k FROM part"""


@query("fn_mention_kind", f"WITH k AS ({_KINDS}) SELECT mention, CASE k WHEN 0 THEN 'value' WHEN 1 THEN 'concept' WHEN 2 THEN 'quantity' WHEN 3 THEN 'concept' WHEN 4 THEN 'value' ELSE 'person' END AS kind FROM k")
def fn_mention_kind(t: Tables) -> DataFrame:
    return mention_kinds(t, t.sql(_KINDS).select("mention", "type"))


def mention_kinds(t: Tables, mentions: DataFrame) -> DataFrame:
    words = tx.tokens(F.col("mention"))
    generic = _generic()
    telling = F.filter(words, lambda w: (F.length(w) >= 3) & w.rlike(r"^\p{L}+$") & ~F.array_contains(generic, w))
    rows = mentions.select("mention", "type", telling.alias("telling"), (F.size(words) >= 2).alias("many"))
    exact = pr.ix.exact_values(pr.index(t)).select(F.col("value").alias("mention_key"), F.lit(True).alias("stored"))
    tags = tg.tag(rows.select(F.col("mention").alias("id"), F.col("mention").alias("text")).distinct(), pr.glossary(t))
    covered = tags.select(F.col("id").alias("mention"), F.flatten(F.transform("tags", lambda m: F.split(m["trigger"], " "))).alias("covered"))
    shaped = pr.pf.names_a_column(rows.select("mention").distinct(), pr.head_words(t)).select("mention", F.lit(True).alias("shaped"))
    joined = rows.withColumn("mention_key", pr.ix.normal(F.col("mention"))).join(exact, "mention_key", "left").join(covered, "mention", "left").join(shaped, "mention", "left")
    all_covered = F.coalesce(F.size(F.array_except("telling", "covered")) == 0, F.lit(False))
    kind = tx.mention_kind(F.col("type"), tx.name_shaped(F.col("mention"), generic), F.size("telling"), F.col("many") & F.coalesce("stored", F.lit(False)), all_covered, F.coalesce("shaped", F.lit(False)))
    return joined.select("mention", kind.alias("kind"))


# Tagging

_SINGLE = f"{pr.GLOSSARY_SQL}, messages AS ({MESSAGES}), trig AS (SELECT term, replace(term, '_', ' ') AS trigger FROM glossary UNION SELECT term, unnest(synonyms) FROM glossary), tags AS (SELECT id, term, trigger, place FROM (SELECT id, generate_subscripts(ws, 1) - 1 AS place, unnest(ws) AS w FROM (SELECT id, regexp_extract_all(lower(text), '[a-z0-9&]+') AS ws FROM messages)) JOIN trig ON trigger = w QUALIFY row_number() OVER (PARTITION BY id, term ORDER BY place) = 1)"


@query("glossary_tag", f"WITH {_SINGLE} SELECT id, place::int AS place, term, trigger FROM tags")
def glossary_tag(t: Tables) -> DataFrame:
    tags = tg.tag(t.sql(MESSAGES), pr.glossary(t))
    return tags.select("id", F.explode("tags").alias("t")).select("id", F.col("t.position").alias("place"), "t.term", "t.trigger")


@query("text_scope", f"WITH {_SINGLE}, c AS (SELECT id, place, i, columns[i] AS ref FROM tags JOIN glossary USING (term), range(1, 5) r(i) WHERE i <= len(columns)) SELECT id, string_agg(ref, '|' ORDER BY place, i) AS columns, (SELECT string_agg(note, '|' ORDER BY place) FROM tags x JOIN glossary USING (term) WHERE x.id = c.id AND note IS NOT NULL) AS notes FROM c GROUP BY id")
def text_scope(t: Tables) -> DataFrame:
    glossary = pr.glossary(t)
    scope = tg.scope(tg.tag(t.sql(MESSAGES), glossary), glossary)
    return scope.select("id", F.array_join("columns", "|").alias("columns"), F.when(F.size("notes") > 0, F.array_join("notes", "|")).alias("notes"))


def entities(t: Tables) -> DataFrame:
    """Tagger output for the messages: a map of type to spans, places partly missing."""
    one = lambda c, s, at, end: F.struct(F.col(c).alias("text"), s.alias("score"), at.alias("start"), end.alias("end"))
    none = F.lit(-1)
    at = F.instr("text", F.col("o_orderpriority")) - 1
    rows = t.sql("SELECT o_orderkey AS id, concat('How many ', c_mktsegment, ' orders at ', o_orderpriority) AS text, c_mktsegment, o_orderpriority, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
    segment = F.array(one("c_mktsegment", F.lit(0.91234567), none, none), one("o_orderpriority", F.lit(0.5), at, at + F.length("o_orderpriority")))
    return rows.select("id", "text", F.create_map(F.lit("segment"), segment, F.lit("priority"), F.array(one("o_orderpriority", F.lit(0.8), none, none))).alias("entities"))


@query("entities_flatten", "WITH m AS (SELECT o_orderkey AS id, c_mktsegment AS s, o_orderpriority AS p FROM orders JOIN customer ON o_custkey = c_custkey) SELECT id, 'segment' AS type, s AS entity, 0.9123::double AS score, 9 AS start, 9 + length(s) AS \"end\" FROM m UNION ALL SELECT id, type, p, score, 20 + length(s), 20 + length(s) + length(p) FROM m, (VALUES ('segment', 0.5::double), ('priority', 0.8::double)) v(type, score)")
def entities_flatten(t: Tables) -> DataFrame:
    return tg.flatten_entities(entities(t))


@query("entities_fallback", f"WITH {_SINGLE} SELECT id, term AS type, trigger AS entity, 0.5::double AS score, -1 AS start, -1 AS \"end\" FROM tags")
def entities_fallback(t: Tables) -> DataFrame:
    return tg.fallback_entities(t.sql(MESSAGES), pr.glossary(t))


@query("span_dedup", "WITH m AS (SELECT o_orderkey AS id, c_mktsegment AS s, o_orderpriority AS p FROM orders JOIN customer ON o_custkey = c_custkey) SELECT id, s || ':segment|' || p || ':priority' AS spans FROM m")
def span_dedup(t: Tables) -> DataFrame:
    kept = tg.dedup_spans(tg.flatten_entities(entities(t)))
    return kept.select("id", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["entity"], s["type"])), "|").alias("spans"))


@query("entity_scope", "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'part.p_name|part.p_type|orders.o_totalprice|customer.c_name' WHEN 1 THEN 'nation.n_name|region.r_name|customer.c_name' ELSE 'customer.c_name' END AS columns FROM orders")
def entity_scope(t: Tables) -> DataFrame:
    kinds = t.spark.createDataFrame([("product", ["part", "revenue"]), ("place", ["country", "world_region"])], "type string, terms array<string>")
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "product").when(F.col("o_orderkey") % 3 == 1, "place").otherwise("other").alias("type"), F.array(F.lit("customer.c_name")).alias("fallback"))
    return tg.entity_scope(rows, kinds, pr.glossary(t)).select("id", F.array_join("columns", "|").alias("columns"))


# Masking

RESOLUTIONS = """SELECT id, place, mention, value, ref, score, kind FROM (
  SELECT o_orderkey AS id, 0 AS place, lower(c_mktsegment) AS mention, c_mktsegment AS value, 'customer.c_mktsegment' AS ref, 1.0 AS score, 'value' AS kind FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT o_orderkey, 1, o_orderpriority, o_orderpriority, 'orders.o_orderpriority', 1.0, 'value' FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT o_orderkey, 2, cast(cast(floor(o_totalprice) AS bigint) AS string), cast(cast(floor(o_totalprice) AS bigint) AS string), CAST(NULL AS string), 1.0, 'quantity' FROM orders WHERE o_orderkey % 3 <> 0) r"""
_NUMBERED = f"numbered AS (SELECT *, ':v' || row_number() OVER (PARTITION BY id ORDER BY length(mention) DESC, place) AS symbol FROM ({RESOLUTIONS}))"
DOUBTS = """SELECT o_orderkey AS id, 0 AS place, o_orderpriority AS mention, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS value, CASE WHEN o_orderkey % 4 = 1 THEN 0.6 ELSE 0.9 END AS score, 'value' AS kind FROM orders
  UNION ALL SELECT o_orderkey, 1, concat('Mr ', o_custkey), CAST(NULL AS string), 0.0, CASE WHEN o_orderkey % 7 = 0 THEN 'person' ELSE 'concept' END FROM orders"""


def numbered(t: Tables) -> DataFrame:
    return mk.number_symbols(t.sql(RESOLUTIONS))


@query("symbol_numbering", f"WITH {_NUMBERED} SELECT id, mention, symbol FROM numbered")
def symbol_numbering(t: Tables) -> DataFrame:
    return numbered(t).select("id", "mention", "symbol")


_COUNTED = f"WITH {pr.VALUES_SQL}, m AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS mention, 'part.p_name' AS ref FROM part UNION SELECT DISTINCT o_orderpriority, 'orders.o_orderpriority' FROM orders) SELECT mention, ref, count(*) AS n FROM m JOIN value_index USING (ref) WHERE contains(lower(value), lower(mention)) GROUP BY ALL"


@query("spelling_multiplicity", _COUNTED)
def spelling_multiplicity(t: Tables) -> DataFrame:
    mentions = t("part").select(F.split("p_name", " ")[0].alias("mention"), F.lit("part.p_name").alias("ref")).union(t("orders").select("o_orderpriority", F.lit("orders.o_orderpriority")))
    return mk.spellings(mentions, pr.index(t))


@query("mask_text", f"WITH {_NUMBERED}, messages AS ({MESSAGES}), p AS (SELECT id, max(mention) FILTER (place = 0) AS m0, max(symbol) FILTER (place = 0) AS s0, max(mention) FILTER (place = 1) AS m1, max(symbol) FILTER (place = 1) AS s1, max(mention) FILTER (place = 2) AS m2, max(symbol) FILTER (place = 2) AS s2 FROM numbered GROUP BY id) SELECT id, CASE WHEN m0 IS NULL THEN text ELSE regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\b' || m0 || '\\b', s0), '(?i)\\b' || m1 || '\\b', s1), '\\b' || m2 || '\\b', s2) END AS masked FROM messages LEFT JOIN p USING (id)")
def mask_text(t: Tables) -> DataFrame:
    return mk.mask(t.sql(MESSAGES), numbered(t))


@query("mask_vault", f"WITH {_NUMBERED}, {pr.VALUES_SQL}, counted AS (SELECT mention, ref, count(*) AS n FROM (SELECT DISTINCT mention, ref FROM numbered) JOIN value_index USING (ref) WHERE contains(lower(value), lower(mention)) GROUP BY ALL) SELECT id, symbol, value, ref, CASE WHEN n > 1 THEN '%' || mention || '%' END AS pattern FROM numbered LEFT JOIN counted USING (mention, ref)")
def mask_vault(t: Tables) -> DataFrame:
    rows = numbered(t)
    return mk.vault(rows, mk.spellings(rows.filter("ref is not null"), pr.index(t)))


@query("refusals", f"WITH d AS ({DOUBTS}), g AS (SELECT id, string_agg(DISTINCT mention, '|' ORDER BY mention) FILTER (kind = 'person') AS persons, string_agg(DISTINCT mention, '|' ORDER BY mention) FILTER (kind = 'value' AND (value IS NULL OR score < 0.75)) AS unknown FROM d GROUP BY id) SELECT id, CASE WHEN persons IS NOT NULL THEN 'person named' ELSE 'value not recognised' END AS reason, coalesce(persons, unknown) AS mentions FROM g WHERE persons IS NOT NULL OR unknown IS NOT NULL")
def refusals(t: Tables) -> DataFrame:
    return mk.refusals(t.sql(DOUBTS))


_OFFERS = "SELECT id, place, mention, value, score, kind, concat('orders.o_orderpriority = ', mention) AS one, concat('part.p_name = x', id % 5) AS two FROM doubts"


@query("refusal_suggestions", f"WITH doubts AS ({DOUBTS}) SELECT id, mention, CASE WHEN value IS NOT NULL AND score >= 0.65 THEN value || '|' WHEN value IS NULL OR value <> mention OR score < 0.65 THEN '' END || CASE WHEN value IS NOT NULL AND score >= 0.65 AND value = mention THEN '' ELSE mention || '|' END || 'x' || (id % 5) AS offered FROM doubts WHERE kind = 'value' AND (value IS NULL OR score < 0.75)")
def refusal_suggestions(t: Tables) -> DataFrame:
    rows = t.sql(_OFFERS, doubts=t.sql(DOUBTS)).withColumn("alternatives", F.array("one", "two", F.lit("no value")))
    return mk.suggestions(rows).withColumn("offered", F.array_join("offered", "|"))


@query("fn_preview", "SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 90) AS preview FROM documents")
def fn_preview(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query("confidence_split", f"WITH d AS ({DOUBTS}) SELECT CASE WHEN kind <> 'value' THEN 'not a value' WHEN value IS NULL THEN 'unresolved' WHEN score >= 0.75 THEN 'confident' ELSE 'needs confirmation' END AS status, count(*) AS n FROM d GROUP BY 1")
def confidence_split(t: Tables) -> DataFrame:
    return mk.confidence(t.sql(DOUBTS)).groupBy("status").agg(F.count("*").alias("n"))


@query("public_view", f"WITH {_NUMBERED} SELECT id, count(*)::int AS n_mapping FROM numbered GROUP BY id")
def public_view(t: Tables) -> DataFrame:
    state = numbered(t).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "value"))).alias("mapping"), F.max("mention").alias("secret"))
    return mk.public_view(state, ["id", "mapping"])


# Pseudonyms

_SEED = 7
_names = ["nation", "region"], ["n_nationkey", "n_name", "n_regionkey", "r_regionkey", "r_name"]


def _drawn(names: list[str], letter: str) -> dict[str, str]:
    return {n: f"{letter}{i}" for i, n in enumerate(sorted(names, key=lambda n: hashlib.md5(f"{_SEED}{n}".encode()).hexdigest()), 1)}


_DRAWN = _drawn(_names[0], "t") | _drawn(_names[1], "c")


def drawn(t: Tables) -> dict[str, str]:
    """The labels of the two tables and their columns: as many rows as there are names."""
    columns = pr.columns(t, ["nation", "region"])
    both = mk.labels(columns.select(F.col("table_name").alias("name")), "t", _SEED).unionAll(mk.labels(columns.select(F.col("column_name").alias("name")), "c", _SEED))
    return {r["name"]: r["label"] for r in both.collect()}


_LABELS_SQL = lambda column, letter: f"SELECT name, '{letter}' || row_number() OVER (ORDER BY md5('{_SEED}' || name)) AS label FROM (SELECT DISTINCT {column} AS name FROM inventory)"


@query("pseudonym_map", f"WITH {pr.INVENTORY_SQL} {_LABELS_SQL('table_name', 't')} UNION ALL {_LABELS_SQL('column_name', 'c')}")
def pseudonym_map(t: Tables) -> DataFrame:
    one, two = every_label(t)
    return one.unionAll(two)


def every_label(t: Tables) -> tuple[DataFrame, DataFrame]:
    columns = pr.columns(t)
    return tuple(mk.labels(columns.select(F.col(c).alias("name")), letter, _SEED) for c, letter in (("table_name", "t"), ("column_name", "c")))


@query("pseudonym_relations", f"WITH {pr.FKS_SQL}, tl AS ({_LABELS_SQL('table_name', 't')}), cl AS ({_LABELS_SQL('column_name', 'c')}) SELECT a.label AS table_label, b.label AS column_label, c.label AS ref_table_label, d.label AS ref_column_label FROM links JOIN tl a ON a.name = table_name JOIN cl b ON b.name = column_name JOIN tl c ON c.name = ref_table JOIN cl d ON d.name = ref_column WHERE table_name <> 'lineitem' AND ref_table <> 'lineitem'")
def pseudonym_relations(t: Tables) -> DataFrame:
    tables, columns = every_label(t)
    return mk.relations(pr.fk_inference(t), tables.filter("name <> 'lineitem'"), columns)


@query("pseudonymise_table", f"SELECT n_nationkey AS {_DRAWN['n_nationkey']}, n_name AS {_DRAWN['n_name']}, n_regionkey AS {_DRAWN['n_regionkey']} FROM nation")
def pseudonymise_table(t: Tables) -> DataFrame:
    return mk.pseudonymise(t("nation"), drawn(t))


_LABELLED = f"SELECT o_orderkey AS log_id, concat('SELECT {_DRAWN['n_name']}, c', o_orderkey % 7, ' FROM {_DRAWN['nation']} JOIN t', o_orderkey % 4, ' ON {_DRAWN['nation']}.{_DRAWN['n_regionkey']} > ', o_custkey) AS sql FROM orders"
_RESTORED = "sql"
for _name, _label in sorted(_DRAWN.items(), key=lambda p: -len(p[1])):
    _RESTORED = f"regexp_replace({_RESTORED}, '\\b{_label}\\b', '{_name}', 'g')"


@query("restore_labels", f"WITH l AS ({_LABELLED}) SELECT log_id, {_RESTORED} AS sql FROM l")
def restore_labels(t: Tables) -> DataFrame:
    return mk.restore(t.sql(_LABELLED), list(drawn(t).items()))


_ISSUED = "[" + ", ".join(f"'{v}'" for v in _DRAWN.values()) + "]"


@query("invented_labels", f"WITH l AS ({_LABELLED}) SELECT log_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(sql, '\\b[tc]\\d+\\b'), lambda w: NOT list_contains({_ISSUED}, w)))), ',') AS invented FROM l")
def invented_labels(t: Tables) -> DataFrame:
    return mk.invented(t.sql(_LABELLED), list(drawn(t).values())).withColumn("invented", F.array_join("invented", ","))


@query("rewrite_labels", f"WITH messages AS ({MESSAGES}) SELECT id, regexp_replace(regexp_replace(text, '(?i)\\bsegment\\b', 't1.c1', 'g'), '(?i)\\bregion\\b', 't2.c5', 'g') AS text FROM messages")
def rewrite_labels(t: Tables) -> DataFrame:
    texts, glossary = t.sql(MESSAGES), pr.glossary(t)
    return mk.rewrite(texts, tg.tag(texts, glossary), glossary, {"customer.c_mktsegment": "t1.c1", "region.r_name": "t2.c5"})


@query("rewrite_notes", f"WITH {_SINGLE}, l AS (SELECT id, place, length(trigger) AS n, CASE term WHEN 'segment' THEN 't1.c1 is the subject of the question' WHEN 'world_region' THEN 't2.c5 is the subject of the question' WHEN 'part' THEN 't3.c7 is the subject of the question; related columns: t3.c8' END AS note FROM tags) SELECT id, string_agg(note, '|' ORDER BY n DESC, place) AS notes FROM l WHERE note IS NOT NULL GROUP BY id")
def rewrite_notes(t: Tables) -> DataFrame:
    labels = {"customer.c_mktsegment": "t1.c1", "region.r_name": "t2.c5", "part.p_name": "t3.c7", "part.p_type": "t3.c8"}
    glossary = pr.glossary(t)
    return mk.rewrite_notes(tg.tag(t.sql(MESSAGES), glossary), glossary, labels).withColumn("notes", F.array_join("notes", "|"))


_EXPECTED = "SELECT concat('set', o_orderkey % 3) AS set, o_orderkey AS id, o_orderpriority AS item FROM orders UNION ALL SELECT concat('set', o_orderkey % 3), o_orderkey, o_orderstatus FROM orders"
_RESOLVED = "SELECT concat('set', o_orderkey % 3) AS set, o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN '9-NONE' ELSE o_orderpriority END AS item FROM orders WHERE o_orderkey % 4 <> 0"


@query("labelled_recall", f"WITH e AS ({_EXPECTED}), r AS ({_RESOLVED}), j AS (SELECT set, e.item AS w, r.item AS g FROM e FULL JOIN r USING (set, id, item)) SELECT set, count(w) AS expected, count(g) FILTER (w IS NOT NULL) AS found, count(g) FILTER (w IS NULL) AS extra, round(count(g) FILTER (w IS NOT NULL) / count(w), 4) AS recall, round(count(g) FILTER (w IS NOT NULL) / count(g), 4) AS precision FROM j GROUP BY set")
def labelled_recall(t: Tables) -> DataFrame:
    return mk.labelled_recall(t.sql(_EXPECTED), t.sql(_RESOLVED))
