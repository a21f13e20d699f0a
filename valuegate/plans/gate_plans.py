"""Gate and SQL-log queries over messages and logs made from ``orders`` and ``customer``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegate.operators import gate, sqllog
from valuegate.operators import index as ix
from valuegate.operators import journal as jr
from valuegate.plans import profiling as pr
from valuegate.plans.registry import Tables, query
from valuegate.sources import questions as qs
from valuegate.sources.folders import new_folder, stored
from valuegate.sources.local import local_rows

MESSAGES = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'How many orders per segment and region in total?'
  ELSE concat('How many orders for ', c_name, ' in ', c_mktsegment, ' with priority ', o_orderpriority, ' over ', cast(cast(floor(o_totalprice) AS bigint) AS string)) END AS text FROM orders JOIN customer ON o_custkey = c_custkey"""
REPLIES = "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN concat('The most common part is the ', upper(p_name), '.') ELSE concat('There are ', p_size, ' of them.') END AS text FROM part"
CONSTANT, TEMPLATE = "You answer questions about orders.", "Use t1 with 10 rows"
SEGMENTS = f"""SELECT id, 1 AS part, 'authored' AS origin, CASE WHEN id % 5 = 0 THEN 'You answer questions about BUILDING.' ELSE '{CONSTANT}' END AS text FROM messages
  UNION ALL SELECT id, 2, 'question', text FROM messages
  UNION ALL SELECT id, 3, 'params', CASE WHEN id % 7 = 0 THEN '  :v1 = a value of customer.c_secret' WHEN id % 7 = 1 THEN '  (none)' ELSE '  :v1 = a value of customer.c_mktsegment' END FROM messages
  UNION ALL SELECT id, 4, 'opaque', CASE WHEN id % 11 = 0 THEN 'CREATE TABLE t1 (c1 MACHINERY)' ELSE 'CREATE TABLE t1 (c1 INT, c2 TEXT)' END FROM messages
  UNION ALL SELECT id, 5, 'schema', CASE WHEN id % 13 = 0 THEN 'CREATE TABLE orders (o_shade INT)' ELSE 'CREATE TABLE orders (o_orderkey INT PRIMARY KEY)' END FROM messages
  UNION ALL SELECT id, 6, 'template', concat('Use t', id % 4, ' with ', id, CASE WHEN id % 17 = 0 THEN ' columns' ELSE ' rows' END) FROM messages
  UNION ALL SELECT id, 7, 'glossary', CASE WHEN id % 19 = 0 THEN 'segments are lower case' ELSE 'segments are upper case' END FROM messages"""
_LOG = [
    "SELECT count(DISTINCT o.o_custkey) FROM orders o WHERE o.o_orderpriority = :v1", "", "-- nothing", "SELECT 1; DROP TABLE orders", "DELETE FROM orders", "SELECT load_extension(1)",
    "SELECT AVG(o_price) FROM orders WHERE o_custkey = :v1", "SELECT o_custkey FROM orders WHERE o_orderkey = :v2", "SELECT MAX(o_totalprice) FROM orders",
    "WITH x AS (SELECT c_name FROM customer) SELECT x.c_name FROM x JOIN lineitem ON 1 = 1 /* drop */",
    "SELECT ''; drop'' AS s, o.o_colour FROM orders o;", "SELECT o_custkey AS s FROM orders /* never closed; drop", "SELECT o_custkey FROM orders o WHERE o.o_tone = ''it''''s; drop", "CREATE TABLE z (a int)",
]
LOG = "SELECT o_orderkey AS log_id, CASE " + " ".join(f"WHEN o_orderkey % {len(_LOG)} = {i} THEN '{s}'" for i, s in enumerate(_LOG)) + f" END AS sql, o_orderkey % {len(_LOG)} IN (0, 6, 7, 8) AS bound FROM orders"

_WS = f"SELECT id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM (SELECT id, regexp_extract_all(lower(text), '{gate.WORD.replace('A-Z', '')}') AS ws FROM {{0}})"
_KNOWN = """grams AS (SELECT id, 1 AS size, w AS value FROM toks UNION SELECT id, 2, w || ' ' || lead(w) OVER (PARTITION BY id ORDER BY pos) FROM toks),
  known AS (SELECT DISTINCT id, value, size FROM grams WHERE value IN (SELECT value FROM exact) AND (size > 1 OR (value NOT IN (SELECT word FROM allowed) AND length(value) >= 3 AND regexp_matches(value, '\\p{L}'))))"""
_over = lambda text, name: text.replace("{0}", name)
_BASE = f"WITH {pr.EXACT_SQL}, {pr.ALLOWED_SQL}, {pr.TOKENS_SQL}, messages AS ({MESSAGES}), toks AS ({_over(_WS, 'messages')}), {_KNOWN}"
_SHAPED = " OR ".join(f"regexp_matches(token, '{p}')" for p in gate.PATTERNS)
_CUT = f"regexp_extract_all(text, '{gate.TOKEN}')"
_REFUSED = f"""tokens AS (SELECT id, generate_subscripts(ts, 1) - 1 AS place, unnest(ts) AS token FROM (SELECT id, {_CUT} AS ts FROM {{0}})),
  refused AS (SELECT id, arg_min(token, place) AS token, min(place) AS place FROM tokens WHERE NOT ({_SHAPED}) AND length(token) >= 3 AND regexp_matches(token, '\\p{{L}}') AND lower(token) NOT IN ({', '.join(f"'{n}'" for n in ix.NUMERALS)})
  AND lower(token) IN (SELECT token FROM value_tokens) AND lower(token) NOT IN (SELECT word FROM allowed) GROUP BY id, lower(token))"""
_VERDICT = f"""verdict AS (SELECT m.id, k.vs IS NULL AND r.ts IS NULL AS allowed, coalesce(k.vs, r.ts, []::varchar[]) AS refused, len({_CUT})::int AS n_tokens, substr(sha256(text), 1, 16) AS fingerprint,
  CASE WHEN k.vs IS NOT NULL THEN '{gate.DENYLIST}' ELSE '{gate.MEMBERSHIP}' END AS rule FROM {{0}} m LEFT JOIN (SELECT id, list(value ORDER BY -size, value) AS vs FROM known GROUP BY id) k USING (id) LEFT JOIN (SELECT id, list(token ORDER BY place, token) AS ts FROM refused GROUP BY id) r USING (id))"""


def messages(t: Tables) -> DataFrame:
    return t.sql(MESSAGES)


def known(t: Tables, texts: DataFrame) -> DataFrame:
    return gate.known_values(texts, pr.denylist(t))


def verdict(t: Tables, texts: DataFrame) -> DataFrame:
    deny = pr.denylist(t)
    return gate.verdicts(texts, gate.known_values(texts, deny), gate.refused_tokens(texts, deny))


@query("gate_known_values", f"{_BASE} SELECT * FROM known")
def gate_known_values(t: Tables) -> DataFrame:
    return known(t, messages(t))


@query("gate_tokens", f"{_BASE}, {_over(_REFUSED, 'messages')} SELECT id, token, place FROM refused")
def gate_tokens(t: Tables) -> DataFrame:
    return gate.refused_tokens(messages(t), pr.denylist(t))


@query("gate_verdict", f"{_BASE}, {_over(_REFUSED, 'messages')}, {_over(_VERDICT, 'messages')} SELECT id, allowed, array_to_string(refused, '|') AS refused, n_tokens, fingerprint, rule FROM verdict")
def gate_verdict(t: Tables) -> DataFrame:
    return verdict(t, messages(t)).withColumn("refused", F.array_join("refused", "|"))


@query("gate_sweep", f"WITH {pr.EXACT_SQL}, {pr.ALLOWED_SQL}, replies AS ({REPLIES}), toks AS ({_over(_WS, 'replies')}), {_KNOWN} SELECT * FROM known")
def gate_sweep(t: Tables) -> DataFrame:
    return known(t, t.sql(REPLIES))


_LINES = f"""SELECT 'send' AS context, v.allowed, array_to_string(v.refused, '|') AS refused, v.n_tokens::bigint AS token_count, v.fingerprint, length(m.text)::bigint AS length, false AS bypassed FROM verdict v JOIN messages m USING (id) WHERE id % 10 <> 0
  UNION ALL SELECT 'baseline', true, '', 0, '', length(text), true FROM messages WHERE id % 10 = 0"""


@query("gate_journal", f"{_BASE}, {_over(_REFUSED, 'messages')}, {_over(_VERDICT, 'messages')} {_LINES}")
def gate_journal(t: Tables) -> DataFrame:
    """Verdicts and deliberate bypasses appended to a journal and read again."""
    folder, now = new_folder(t.spark, "journal"), F.current_timestamp()
    texts, past = (messages(t).filter(f"id % 10 {op} 0") for op in ("<>", "="))
    jr.append(jr.verdict_lines(verdict(t, texts), texts, "send", now), folder)
    jr.append(jr.bypass_lines(past, "baseline", now), folder)
    lines = jr.scan(t.spark, folder)
    return lines.select("context", "allowed", F.array_join("refused_tokens", "|").alias("refused"), "token_count", "fingerprint", "length", "bypassed")


@query("gate_sweep_journal", f"WITH {pr.EXACT_SQL}, {pr.ALLOWED_SQL}, replies AS ({REPLIES}), toks AS ({_over(_WS, 'replies')}), {_KNOWN} SELECT 'answer' AS context, false AS allowed, (SELECT string_agg(value, '|' ORDER BY -size, value) FROM known k WHERE k.id = r.id) AS refused, len({_CUT})::bigint AS token_count, substr(sha256(text), 1, 16) AS fingerprint FROM replies r WHERE id IN (SELECT id FROM known)")
def gate_sweep_journal(t: Tables) -> DataFrame:
    replies = t.sql(REPLIES)
    lines = jr.sweep_lines(known(t, replies), replies, "answer", F.current_timestamp())
    return lines.select("context", "allowed", F.array_join("refused_tokens", "|").alias("refused"), "token_count", "fingerprint")


_RULE = f"""ruled AS (SELECT *, CASE WHEN origin = 'authored' AND text = '{CONSTANT}' THEN '{gate.RULES["authored"]}'
  WHEN origin = 'template' AND regexp_matches(text, '^Use t\\d+ with \\d+ rows$') THEN '{gate.RULES["template"]}'
  WHEN origin = 'schema' AND text LIKE '%o_orderkey%' THEN '{gate.RULES["schema"]}'
  WHEN origin = 'params' AND text NOT LIKE '%c_secret%' THEN '{gate.RULES["params"]}'
  WHEN origin = 'opaque' AND text NOT LIKE '%MACHINERY%' THEN '{gate.RULES["opaque"]}'
  WHEN origin = 'glossary' AND text = 'segments are upper case' THEN '{gate.RULES["glossary"]}' END AS rule FROM segments)"""


def provenance(t: Tables) -> DataFrame:
    segments = t.sql(SEGMENTS, messages=messages(t))
    one = lambda text, f: local_rows(t.spark, [(text,)], "text string").select(F.sha2(f(F.col("text")), 256).alias("digest"))
    identifiers = pr.dic.schema_words(pr.columns(t))
    notes = pr.glossary(t).filter("note is not null").select("note")
    return gate.provenance(segments, one(CONSTANT, lambda c: c), one(TEMPLATE, gate.templated), identifiers, notes)


@query("gate_provenance", f"WITH messages AS ({MESSAGES}), segments AS ({SEGMENTS}), {_RULE} SELECT id, part, origin, text, rule FROM ruled")
def gate_provenance(t: Tables) -> DataFrame:
    return provenance(t)


@query(
    "gate_message",
    f"""WITH {pr.EXACT_SQL}, {pr.ALLOWED_SQL}, {pr.TOKENS_SQL}, messages AS ({MESSAGES}), segments AS ({SEGMENTS}), {_RULE}, open AS (SELECT id * 10 + part AS id, text FROM ruled WHERE rule IS NULL), toks AS ({_over(_WS, 'open')}), {_KNOWN}, {_over(_REFUSED, 'open')}, {_over(_VERDICT, 'open')}
    SELECT r.id, bool_and(r.rule IS NOT NULL OR v.allowed) AS allowed, array_to_string(list_sort(list_distinct(flatten(list(coalesce(v.refused, []::varchar[]))))), '|') AS refused FROM ruled r LEFT JOIN verdict v ON v.id = r.id * 10 + r.part GROUP BY r.id""",
)
def gate_message(t: Tables) -> DataFrame:
    """The flagship: which outgoing messages hold values of the data?"""
    # Written once: the texts of parts that nothing vouches for are read several times, the others are not needed.
    parts = stored(provenance(t).select("id", "part", "rule", F.when(F.col("rule").isNull(), F.col("text")).alias("text")), "parts")
    loose = parts.filter("rule is null").select((F.col("id") * 10 + F.col("part")).alias("id"), "text")
    checked = verdict(t, loose).select(F.floor(F.col("id") / 10).alias("id"), (F.col("id") % 10).cast("int").alias("part"), "allowed", "refused")
    return gate.message_verdicts(parts, checked).withColumn("refused", F.array_join("refused", "|"))


def _log(t: Tables) -> DataFrame:
    return t.sql(LOG).withColumn("expected", F.when(F.col("bound"), F.array(F.lit(":v1"))))


def _schema(t: Tables) -> list[tuple[str, str]]:
    return [(r["table_name"].lower(), r["column_name"].lower()) for r in pr.columns(t).collect()]


_sq = lambda p: "'" + p.replace("'", "''") + "'"
_BARE = f"regexp_replace(regexp_replace(regexp_replace(trim(sql), {_sq(sqllog.COMMENT)}, ' ', 'g'), {_sq(sqllog.STRING)}, {_sq(sqllog.BLANK)}, 'g'), {_sq(sqllog.ENDS)}, '', 'g')"
_LINT = f"""WITH {pr.INVENTORY_SQL}, log AS (SELECT *, {_BARE} AS bare, CASE WHEN bound THEN [':v1'] END AS expected FROM ({LOG})),
  schema_columns AS (SELECT list((lower(table_name), lower(column_name))) AS pairs, list(lower(column_name)) AS names FROM inventory),
  cut AS (SELECT *, list_transform(regexp_extract_all(bare, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: lower(w)) AS words, list_distinct(regexp_extract_all(sql, ':v\\d+')) AS used,
    list_transform(regexp_extract_all(bare, {_sq(sqllog.SOURCE)}, 1), lambda w: lower(w)) AS sources FROM log, schema_columns),
  scoped AS (SELECT *, list_transform(list_filter(pairs, lambda p: list_contains(sources, p[1])), lambda p: p[2]) AS scope FROM cut),
  found AS (SELECT *, list_distinct(list_concat(list_filter(regexp_extract_all(bare, {_sq(sqllog.QUALIFIED)}, 1), lambda w: NOT list_contains(names, lower(w))),
    CASE WHEN len(scope) > 0 THEN list_filter(regexp_extract_all(bare, {_sq(sqllog.AGGREGATE)}, 1), lambda w: NOT list_contains(scope, lower(w))) ELSE [] END)) AS invented FROM scoped)"""
_IN = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(
    "sql_log_lint",
    f"""{_LINT}, r AS (SELECT log_id, CASE WHEN trim(sql) = '' THEN 'empty' WHEN bare = '' THEN 'empty after comments' WHEN contains(bare, ';') THEN 'multiple statements' WHEN len(words) = 0 THEN 'no keyword'
    WHEN words[1] NOT IN ('select', 'with') THEN 'starts with ' || words[1]
    WHEN len(list_intersect(words, {_IN(sqllog.STATEMENTS)})) > 0 THEN 'forbidden statement: ' || array_to_string(list_sort(list_intersect(words, {_IN(sqllog.STATEMENTS)})), ', ')
    WHEN len(list_intersect(words, {_IN(sqllog.FUNCTIONS)})) > 0 THEN 'forbidden function: ' || array_to_string(list_sort(list_intersect(words, {_IN(sqllog.FUNCTIONS)})), ', ')
    WHEN expected IS NOT NULL AND len(list_filter(used, lambda u: NOT list_contains(expected, u))) > 0 THEN 'unknown parameter: ' || array_to_string(list_sort(list_filter(used, lambda u: NOT list_contains(expected, u))), ', ')
    WHEN expected IS NOT NULL AND len(list_filter(expected, lambda u: NOT list_contains(used, u))) > 0 THEN 'unused parameter: ' || array_to_string(list_sort(list_filter(expected, lambda u: NOT list_contains(used, u))), ', ')
    WHEN len(invented) > 0 THEN 'unknown column: ' || array_to_string(invented, ', ') ELSE 'accepted' END AS reason FROM found) SELECT log_id, reason = 'accepted' AS valid, reason FROM r""",
)
def sql_log_lint(t: Tables) -> DataFrame:
    return sqllog.lint(_log(t), _schema(t))


@query("sql_unknown_columns", f"{_LINT} SELECT log_id, unnest(invented) AS column_name FROM found")
def sql_unknown_columns(t: Tables) -> DataFrame:
    log = _log(t).select("log_id", sqllog.bare(F.col("sql")).alias("bare")).withColumn("read", sqllog.sources(F.col("bare")))
    return log.select("log_id", F.explode(sqllog.unknown_columns(F.col("bare"), F.col("read"), _schema(t))).alias("column_name"))


@query("sql_log_tables", f"{_LINT} SELECT table_name, count(*) AS n FROM (SELECT unnest(list_distinct(sources)) AS table_name FROM cut) GROUP BY table_name")
def sql_log_tables(t: Tables) -> DataFrame:
    return sqllog.reads(_log(t))


@query("param_diff", f"{_LINT} SELECT log_id, array_to_string(list_sort(list_filter(used, lambda u: NOT list_contains(expected, u))), ',') AS unknown, array_to_string(list_sort(list_filter(expected, lambda u: NOT list_contains(used, u))), ',') AS unused FROM cut WHERE expected IS NOT NULL")
def param_diff(t: Tables) -> DataFrame:
    return sqllog.parameter_differences(_log(t))


QUESTIONS = """SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN ' ' WHEN p_partkey % 10 = 0 THEN NULL ELSE concat('How many parts of size ', p_size, CASE WHEN p_size % 4 = 0 THEN concat(' are called ', p_name) ELSE '' END, '?') END AS question,
  CASE p_size % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'analytics' ELSE 'hard' END AS set, CASE WHEN p_partkey % 7 <> 0 THEN concat('SELECT count(*) FROM part WHERE p_size = ', p_size) END AS sql FROM part"""


def _questions(t: Tables) -> DataFrame:
    """The set as JSON lines, written and read again; every twentieth line is cut off."""
    folder, rows = new_folder(t.spark, "questions"), t.sql(QUESTIONS)
    line = F.to_json(F.struct("question", "set", "sql"))
    rows.select(F.when(F.col("id") % 20 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(folder)
    return qs.read_questions(t.spark, folder)


_ASKED = f"asked AS (SELECT * FROM ({QUESTIONS}) WHERE id % 20 <> 0 AND trim(question) <> '')"


@query("question_set", f"WITH {_ASKED} SELECT set, count(*) AS n, count(sql) AS n_with_reference FROM asked GROUP BY set")
def question_set(t: Tables) -> DataFrame:
    return _questions(t).groupBy("set").agg(F.count("*").alias("n"), F.count("sql").alias("n_with_reference"))


@query(
    "example_bank",
    f"""WITH {pr.EXACT_SQL}, {pr.ALLOWED_SQL}, {_ASKED}, bank AS (SELECT *, row_number() OVER (ORDER BY question, sql) AS id, question || ' ' || sql AS text FROM (SELECT DISTINCT question, sql FROM asked WHERE sql IS NOT NULL)),
    toks AS ({_over(_WS, 'bank')}), {_KNOWN} SELECT question, sql, sha256('Question: ' || question || chr(10) || 'SQL: ' || sql) AS digest FROM bank WHERE id NOT IN (SELECT id FROM known)""",
)
def example_bank(t: Tables) -> DataFrame:
    return qs.example_bank(_questions(t), pr.denylist(t))
