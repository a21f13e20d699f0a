"""Evaluation and journal queries over runs and journal lines made from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegate.operators import evaluate as ev
from valuegate.operators import journal as jr
from valuegate.plans.registry import Tables, query
from valuegate.sources.local import local_rows

RUNS = """SELECT event_id AS attempt, event_type AS variant, user_id AS question, regexp_extract(props, '([0-9]+)', 1) AS result_hash, value AS ms,
  (event_type <> 'error' OR event_id % 2 = 0) AS success, (event_id % 5 = 0) AS escalated,
  100 + event_id % 400 AS prompt_tokens, event_id % 90 AS completion_tokens, CASE WHEN event_id % 11 <> 0 THEN round(1 + value / 100, 4) END AS perplexity,
  CASE WHEN event_type = 'error' AND event_id % 2 = 1 THEN CASE event_id % 3 WHEN 0 THEN 'gate' WHEN 1 THEN 'mask' ELSE 'sql_validation' END END AS failed_stage,
  concat('model', event_id % 4) AS model FROM events"""
RESULTS = f"SELECT *, coalesce(failed_stage IN ('gate', 'mask'), false) AS refusal FROM ({RUNS})"
GOLD = "SELECT user_id AS question, min(regexp_extract(props, '([0-9]+)', 1)) AS expected FROM events WHERE user_id % 3 = 0 GROUP BY user_id"
JOURNAL = "SELECT event_id, ts AS timestamp, event_type AS context, event_type <> 'error' AS allowed, cast(floor(value) AS bigint) AS length, event_type = 'view' AS bypassed FROM events"
#: Prices a million tokens of three of the four models.
PRICES = [("model0", 0.10, 0.40), ("model1", 0.15, 0.45), ("model2", 0.29, 0.59)]
VARIANTS = ["click", "error", "purchase", "signup", "view"]

_PRICES_SQL = ", ".join(f"('{m}', {a}, {b})" for m, a, b in PRICES)
_COSTED = f"""costed AS (SELECT r.*, round((prompt_tokens * coalesce(price_in, 0) + completion_tokens * coalesce(price_out, 0)) / 1000000.0, 8)::double AS dollars
  FROM results r LEFT JOIN (VALUES {_PRICES_SQL}) p(model, price_in, price_out) USING (model))"""
_SCORED = "scored AS (SELECT c.*, CASE WHEN expected IS NOT NULL THEN success AND result_hash = expected END AS correct FROM costed c LEFT JOIN gold USING (question))"
_ALL = f"WITH results AS ({RESULTS}), gold AS ({GOLD}), {_COSTED}, {_SCORED}"
_CONSENSUS = """counts AS (SELECT question, result_hash, count(*) AS votes FROM results WHERE success AND result_hash NOT IN ('', 'empty') GROUP BY 1, 2),
  ranked AS (SELECT *, row_number() OVER w AS place, lead(votes) OVER w AS next FROM counts WINDOW w AS (PARTITION BY question ORDER BY votes DESC, result_hash)),
  agreed AS (SELECT question, result_hash AS expected FROM ranked WHERE place = 1 AND votes >= 2 AND (next IS NULL OR next < votes))"""
_SUMMARY = """summary AS (SELECT *, CASE WHEN asked > 0 THEN round(executed / asked, 4) ELSE 0 END AS executable_rate, CASE WHEN scored > 0 THEN round(correct / scored, 4) ELSE 0 END AS accuracy,
  round_even(tokens / asked, 0)::bigint AS tokens_per_question, round(dollars / asked * 100, 4) AS dollars_per_100 FROM (
  SELECT variant, count(*) AS asked, count_if(success) AS executed, count_if(coalesce(correct, false)) AS correct, count(correct) AS scored, count_if(refusal) AS refusals, count_if(escalated) AS escalations,
  sum(prompt_tokens + completion_tokens)::bigint AS tokens, round(sum(dollars::decimal(28, 8)), 6)::double AS dollars, round(median(ms), 1) AS ms_median, round(median(perplexity), 3) AS perplexity_median FROM scored GROUP BY variant))"""


def results(t: Tables) -> DataFrame:
    return t.sql(RUNS).withColumn("refusal", ev.is_refusal(F.col("failed_stage")))


def scored(t: Tables) -> DataFrame:
    prices = local_rows(t.spark, PRICES, "model string, price_in double, price_out double")
    return ev.score(ev.cost(results(t), prices), t.sql(GOLD))


@query("run_cost", f"{_ALL} SELECT attempt, model, dollars FROM costed")
def run_cost(t: Tables) -> DataFrame:
    return scored(t).select("attempt", "model", "dollars")


@query("score_reference", f"{_ALL} SELECT attempt, question, correct FROM scored")
def score_reference(t: Tables) -> DataFrame:
    return ev.score(results(t), t.sql(GOLD)).select("attempt", "question", "correct")


@query("variant_summary", f"{_ALL}, {_SUMMARY} SELECT * FROM summary")
def variant_summary(t: Tables) -> DataFrame:
    return ev.summarise(scored(t))


@query("failure_counts", f"{_ALL} SELECT variant, failed_stage, count(*) AS n FROM results WHERE NOT success AND failed_stage IS NOT NULL GROUP BY 1, 2")
def failure_counts(t: Tables) -> DataFrame:
    return ev.failures(results(t))


@query("consensus_reference", f"{_ALL}, {_CONSENSUS} SELECT * FROM agreed")
def consensus_reference(t: Tables) -> DataFrame:
    return ev.consensus(results(t))


@query("scoring_basis", f"{_ALL}, {_CONSENSUS} SELECT coalesce(basis, 'none') AS basis, count(*) AS n_questions FROM (SELECT DISTINCT question FROM results) LEFT JOIN (SELECT question, 'reference' AS basis FROM gold UNION ALL SELECT question, 'consensus' FROM agreed WHERE question NOT IN (SELECT question FROM gold)) USING (question) GROUP BY 1")
def scoring_basis(t: Tables) -> DataFrame:
    return ev.basis(results(t), t.sql(GOLD))


@query(
    "sample_vote",
    f"""{_ALL}, groups AS (SELECT question, result_hash, count(*) AS agreeing, min(coalesce(perplexity, 9.9)) AS best, min(attempt) AS first, arg_min(attempt, (coalesce(perplexity, 9.9), attempt)) AS attempt FROM results WHERE success GROUP BY 1, 2)
    SELECT question, attempt, result_hash, agreeing FROM groups QUALIFY row_number() OVER (PARTITION BY question ORDER BY agreeing DESC, best, first) = 1""",
)
def sample_vote(t: Tables) -> DataFrame:
    return ev.vote(results(t).filter("success"))


@query("variant_rank", f"{_ALL}, {_SUMMARY} SELECT variant, accuracy, row_number() OVER (ORDER BY accuracy DESC, tokens_per_question, ms_median, variant) AS place FROM summary")
def variant_rank(t: Tables) -> DataFrame:
    return ev.rank(ev.summarise(scored(t)))


@query("variant_rank_cost", f"{_ALL}, {_SUMMARY} SELECT variant, accuracy, dollars_per_100, row_number() OVER (ORDER BY accuracy DESC, dollars_per_100, ms_median, variant) AS place FROM summary")
def variant_rank_cost(t: Tables) -> DataFrame:
    return ev.rank_by_cost(ev.summarise(scored(t)))


@query("attempt_totals", f"{_ALL} SELECT question AS run, count(*) AS calls, sum(prompt_tokens)::bigint AS prompt_tokens, sum(completion_tokens)::bigint AS completion_tokens, sum(prompt_tokens + completion_tokens)::bigint AS tokens, sum(dollars::decimal(28, 8))::double AS dollars FROM costed GROUP BY question")
def attempt_totals(t: Tables) -> DataFrame:
    return ev.totals(scored(t).withColumnRenamed("question", "run"))


@query("benchmark_report", f"{_ALL}, {_SUMMARY} SELECT variant, asked, executed, accuracy, tokens FROM summary")
def benchmark_report(t: Tables) -> DataFrame:
    """The summary as JSON lines, written and read again."""
    from valuegate.sources.folders import new_folder

    folder, rows = new_folder(t.spark, "report"), ev.summarise(scored(t))
    rows.coalesce(1).write.json(folder)
    return t.spark.read.schema(rows.schema).json(folder).select("variant", "asked", "executed", "accuracy", "tokens")


@query("outcome_matrix", f"WITH results AS ({RESULTS}) SELECT question, " + ", ".join(f"bool_or(success) FILTER (variant = '{v}') AS {v}" for v in VARIANTS) + " FROM results GROUP BY question")
def outcome_matrix(t: Tables) -> DataFrame:
    return ev.outcomes(results(t), VARIANTS)


@query(
    "split_questions",
    f"WITH results AS ({RESULTS}) SELECT * FROM (SELECT question, CASE WHEN NOT bool_or(ok) THEN 'all fail' WHEN NOT bool_and(ok) THEN 'split' END AS kind FROM (SELECT question, variant, bool_or(success AND ms > 150) AS ok FROM results GROUP BY 1, 2) GROUP BY 1) WHERE kind IS NOT NULL",
)
def split_questions(t: Tables) -> DataFrame:
    return ev.split_questions(results(t).withColumn("success", F.expr("success AND ms > 150")))


_ATTEMPTS = "SELECT user_id * 100000 + event_id - event_id % 3 AS run, event_id % 3 AS rung, user_id % 2 AS starting, event_type <> 'error' AS valid, CASE WHEN event_id % 11 <> 0 THEN 1 + value / 100 END AS perplexity FROM events"


@query(
    "cascade_pick",
    f"""WITH a AS ({_ATTEMPTS}), p AS (SELECT run, min(rung) FILTER (valid AND coalesce(perplexity, 0) <= 1.8) AS first, max(rung) AS last, min(starting) AS starting FROM a WHERE rung >= starting GROUP BY run)
    SELECT run, coalesce(first, last) AS rung, first IS NOT NULL AS accepted, first IS NULL OR first <> starting AS escalated FROM p""",
)
def cascade_pick(t: Tables) -> DataFrame:
    return ev.cascade(t.sql(_ATTEMPTS))


_REPAIRS = "SELECT user_id AS run, event_id AS round, concat('SELECT ', event_type, ' ', event_id % 10) AS sql FROM events"


@query("repair_pick", f"WITH a AS ({_REPAIRS}) SELECT run, arg_max(sql, round) AS sql, count(*) AS rounds, string_agg(sql, ' | ' ORDER BY round) AS history FROM a GROUP BY run")
def repair_pick(t: Tables) -> DataFrame:
    return ev.repaired(t.sql(_REPAIRS))


_CALIBRATION = "SELECT quality = 1 AS correct, n_chars / 1000.0 AS perplexity FROM documents JOIN labels USING (doc_id)"


@query(
    "calibrate_threshold",
    """WITH s AS (SELECT quality = 1 AS correct, (n_chars / 1000.0)::double AS perplexity FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT DISTINCT round_even(perplexity, 2) AS threshold FROM s),
    n AS (SELECT count_if(correct) AS r, count_if(NOT correct) AS w, count(*) AS samples, round(median(perplexity) FILTER (correct), 3) AS median_when_right, round(median(perplexity) FILTER (NOT correct), 3) AS median_when_wrong FROM s),
    k AS (SELECT threshold, count_if(correct AND perplexity <= threshold) AS kept, count_if(NOT correct AND perplexity > threshold) AS caught FROM c, s GROUP BY threshold)
    SELECT threshold, median_when_right, median_when_wrong, round(round(kept / r + caught / w, 12) / 2, 3) AS separates, samples FROM k, n ORDER BY round(kept / r + caught / w, 12) DESC, threshold LIMIT 1""",
)
def calibrate_threshold(t: Tables) -> DataFrame:
    return ev.calibrate(t.sql(_CALIBRATION).withColumn("perplexity", F.col("perplexity").cast("double")))


_ROWS = "SELECT o_orderstatus, o_custkey, o_totalprice, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders"


@query(
    "result_fingerprint",
    f"""WITH r AS ({_ROWS}), c AS (SELECT *, floor(log10(abs(o_totalprice)))::bigint AS e FROM r), f AS (SELECT *, round(o_totalprice / pow(10.0, e - 8))::bigint AS m, pow(10.0, 8 - e)::bigint AS u FROM c),
    s AS (SELECT concat_ws(chr(31), coalesce(o_orderstatus, ''), coalesce(o_custkey::varchar, ''), CASE WHEN m % u = 0 THEN (m // u)::varchar ELSE m || 'e' || e END, coalesce(o_orderpriority, '')) AS row_text FROM f)
    SELECT count(*) || ':' || sum(('0x' || substr(sha256(row_text), 1, 15))::bigint) AS result_hash, count(*) AS n_rows FROM s""",
)
def result_fingerprint(t: Tables) -> DataFrame:
    return ev.fingerprint(t.sql(_ROWS))


_REPORT = "SELECT count(*) AS sends, count_if(NOT allowed) AS blocked, count_if(allowed) AS allowed, count_if(bypassed) AS bypassed, coalesce(sum(length) FILTER (allowed), 0)::bigint AS characters_sent, round(count_if(NOT allowed) / count(*), 4) AS block_rate"


@query("audit_report", f"WITH j AS ({JOURNAL}) {_REPORT} FROM j")
def audit_report(t: Tables) -> DataFrame:
    return jr.report(t.sql(JOURNAL))


@query("journal_scan", f"WITH j AS ({JOURNAL}) SELECT context, allowed, length, bypassed, count(*) AS n FROM j WHERE event_id % 10 > 1 GROUP BY ALL")
def journal_scan(t: Tables) -> DataFrame:
    line = F.to_json(F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "context", "allowed", "length", "bypassed"))
    # Every tenth line is blank and every tenth is cut off.
    value = F.when(F.col("event_id") % 10 == 0, " ").when(F.col("event_id") % 10 == 1, F.substring(line, 1, 20)).otherwise(line)
    rows = jr.parsed(t.sql(JOURNAL).select(value.alias("value")))
    return rows.groupBy("context", "allowed", "length", "bypassed").agg(F.count("*").alias("n"))


@query("journal_append", f"WITH j AS ({JOURNAL}) {_REPORT} FROM j")
def journal_append(t: Tables) -> DataFrame:
    from valuegate.sources.folders import new_folder

    folder = new_folder(t.spark, "journal")
    lines = t.sql(JOURNAL)
    jr.append(lines.filter("event_id % 2 = 0").drop("event_id"), folder)
    jr.append(lines.filter("event_id % 2 <> 0").drop("event_id"), folder)
    return jr.report(jr.scan(t.spark, folder))


@query("egress_by_arm", "SELECT event_type AS arm, sum(floor(value))::bigint AS chars, sum(event_id % 4)::bigint AS n_values, sum(user_id)::bigint AS tokens FROM events GROUP BY event_type")
def egress_by_arm(t: Tables) -> DataFrame:
    return jr.egress(t.sql("SELECT event_type AS arm, cast(floor(value) AS bigint) AS chars, event_id % 4 AS n_values, user_id AS tokens FROM events"))


@query("step_latency", "SELECT event_type AS id, concat('zone', event_id % 2) AS zone, count(*) AS n, round(sum(value), 2) AS total_ms, round(median(value), 2) AS median_ms, max(value) AS max_ms FROM events GROUP BY ALL")
def step_latency(t: Tables) -> DataFrame:
    # The nested run log: an array of steps for each user and day.
    return jr.step_latency(t.sql("SELECT user_id, cast(ts AS date) AS day, collect_list(named_struct('id', event_type, 'zone', concat('zone', event_id % 2), 'ms', value)) AS steps FROM events GROUP BY user_id, cast(ts AS date)"))


_DETAIL = "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('{{\"rows\": ', event_id % 50, ', \"kind\": \"', event_type, '\", \"more\": {{\"retries\": ', event_id % 3, '}}}}') WHEN 2 THEN '{{\"rows\": \"many\"}}' ELSE '{{\"rows\": 1' END".replace("{{", "{").replace("}}", "}")
_STEP = f"SELECT event_id, user_id, event_type AS id, concat('zone', event_id % 2) AS zone, value AS ms, {_DETAIL} AS detail FROM events"


@query(
    "step_detail",
    f"""WITH s AS ({_STEP}), d AS (SELECT *, json_valid(detail) AS told, CASE WHEN json_valid(detail) THEN detail END AS j FROM s)
    SELECT id, zone, count(*) AS n, count_if(NOT told) AS malformed, round(sum(ms), 2) AS total_ms, sum(CASE WHEN json_type(j, '$.rows') IN ('UBIGINT', 'BIGINT') THEN (j->>'$.rows')::bigint END)::bigint AS n_rows,
      max((j->>'$.more.retries')::bigint) AS most_retries, count(j->>'$.kind') AS n_kinds, max((j->>'$.k')::bigint) AS most_k FROM d GROUP BY id, zone""",
)
def step_detail(t: Tables) -> DataFrame:
    """Latency of steps together with fields of their free-form detail, some of it malformed, from one nested run log."""
    runs = t.sql(f"SELECT user_id, collect_list(named_struct('id', id, 'zone', zone, 'ms', ms, 'detail', detail)) AS steps FROM ({_STEP}) GROUP BY user_id")
    fields = {"n_rows": ("$.rows", "bigint", F.sum), "most_retries": ("$.more.retries", "bigint", F.max), "n_kinds": ("$.kind", "string", F.count), "most_k": ("$.k", "bigint", F.max)}
    return jr.step_detail(runs, fields)
