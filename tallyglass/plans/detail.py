"""Registered queries of the smaller operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass import schemas, views
from tallyglass.functions import text
from tallyglass.operators import decide, detail, measure
from tallyglass.plans.ledger import _STAKES, _items, _priced_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_DIRECTIVES = ("ungrounded@3", "biased@0:0.5", "pii_leak@12:1.5", "nothing@1", "ungrounded", "contradicted@2:.25")


@query(f"""WITH x AS (SELECT event_id, {_list(_DIRECTIVES)}[(event_id % 6 + 1)::INT] AS d FROM events), y AS (SELECT event_id, d, regexp_extract(d, '^([a-z_]+)@', 1) AS defect, regexp_extract(d, '@([0-9]+)', 1) AS s, regexp_extract(d, ':(.*)$', 1) AS p FROM x WHERE contains(d, '@'))
    SELECT event_id, defect, s::INT AS sentence, CASE WHEN p = '' THEN 0.95 ELSE p::DOUBLE END::DOUBLE AS p FROM y WHERE list_contains({_list(schemas.DEFECTS)}, defect) AND (p = '' OR p::DOUBLE BETWEEN 0 AND 1)""")
def force_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select("event_id", detail.directive(views.pick(_DIRECTIVES, F.col("event_id") % 6)).alias("d"))
    return e.filter("d is not null").select("event_id", "d.*")


_NAMES = ("auto", "cheap", "gpt-4o", "")


@query(f"SELECT m AS requested, CASE WHEN m IN ('auto', 'default', '') THEN 'qwen3:8b' WHEN m = 'cheap' THEN 'qwen3:4b' ELSE m END AS served, count(*) AS n FROM (SELECT {_list(_NAMES)}[(event_id % 4 + 1)::INT] AS m FROM events) GROUP BY 1, 2")
def provider_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.table(spark, sf_dir, "events").select(views.pick(_NAMES, F.col("event_id") % 4).alias("requested"))
    return m.groupBy("requested", detail.selected_model(F.col("requested")).alias("served")).agg(F.count("*").alias("n"))


_ERRORS = ("Rate limit reached", "Model is overloaded", "bad request", "Too Many Requests")


@query(f"SELECT m AS message, regexp_matches(lower(m), 'rate limit|quota|overloaded|capacity|too many requests') AS capacity, count(*) AS n FROM (SELECT {_list(_ERRORS)}[(event_id % 4 + 1)::INT] AS m FROM events) GROUP BY 1, 2")
def capacity_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.table(spark, sf_dir, "events").select(views.pick(_ERRORS, F.col("event_id") % 4).alias("message"))
    return m.groupBy("message", detail.capacity_error(F.col("message")).alias("capacity")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT doc_id AS text_id, doc_id % 3 AS tenant, text || ' IL-CANARY-' || (doc_id % 40)::VARCHAR || ' end' AS text FROM documents), c AS (SELECT 'IL-CANARY-' || i::VARCHAR AS canary, i % 3 AS owner FROM range(20) AS r(i))
    SELECT text_id, canary, owner, (instr(text, canary) - 1)::INT AS start, (instr(text, canary) - 1 + length(canary))::INT AS "end", owner <> tenant AS cross_tenant FROM t JOIN c ON regexp_extract(text, 'IL-CANARY-[0-9]+') = canary""")
def canary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    t = views.table(spark, sf_dir, "documents").select(i.alias("text_id"), (i % 3).alias("tenant"), F.concat("text", F.lit(" IL-CANARY-"), (i % 40).cast("string"), F.lit(" end")).alias("text"))
    c = spark.range(20).select(F.concat(F.lit("IL-CANARY-"), F.col("id").cast("string")).alias("canary"), (F.col("id") % 3).alias("owner"))
    return detail.canary_hits(t, c)


@query()
def argument_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments that quote a document of their request, a call for every document, and the taint that follows."""
    d = views.fragments(spark, sf_dir).withColumn("request_id", F.expr("doc_id div 5"))
    quoted = F.array_join(F.slice(F.split("text", r"\s+"), 2, 4), " ")
    calls = d.select("request_id", F.col("doc_id").alias("call_id"), F.to_json(F.struct(quoted.alias("body"), F.lit(5).alias("n"))).alias("args"))
    values = detail.argument_strings(calls).join(calls.select("call_id", "request_id"), "call_id")
    f = d.select("request_id", "doc_id", "text", "provenance")
    return detail.influence(calls.select("call_id", "request_id"), detail.traced(values, f), f)


@query("SELECT user_id, entry_id FROM (SELECT user_id, event_id AS entry_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS n FROM events) WHERE n <= 16")
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("entry_id"), F.col("value").alias("last_used"))
    return detail.lru(e, "user_id", 16).select("user_id", "entry_id")


_REPLIES = ("Yes, supported. Confidence 0.9\nThe passage says so in plain words.", "Not supported, 0.7", "Hard to say", "no: contradicts the source (0.25)")


@query(f"""WITH x AS (SELECT event_id, {_list(_REPLIES)}[(event_id % 4 + 1)::INT] AS t FROM events) SELECT event_id, CASE WHEN regexp_matches(t, '(?i)\\b(not supported|unsupported|contradict\\w*|no)\\b') THEN false WHEN regexp_matches(t, '(?i)\\b(supported|yes)\\b') THEN true END AS supported,
    list_filter(list_transform(regexp_extract_all(t, '[0-9]*\\.?[0-9]+'), lambda v: v::DOUBLE), lambda v: v <= 1)[1] AS confidence, trim(list_filter(string_split(t, chr(10)), lambda v: length(trim(v)) > 20)[1]) AS rationale FROM x""")
def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select("event_id", detail.judge_reply(views.pick(_REPLIES, F.col("event_id") % 4)).alias("r")).select("event_id", "r.*")


_BODIES = ('{"label": "clean"}', "{oops", '{"x": 1}', '{"label": "odd"}', '{"refusal": "no", "label": "clean"}', " ", '{"label": "unclear"}')


@query(f"""WITH x AS (SELECT [200, 200, 200, 429, 500, 401, 402, 404][(event_id % 8 + 1)::INT] AS h, {_list(_BODIES)}[(event_id % 7 + 1)::INT] AS b FROM events) SELECT CASE WHEN h = 429 THEN 'rate_limited' WHEN h = 402 THEN 'no_credit' WHEN h IN (401, 403) THEN 'unauthorized' WHEN h >= 500 THEN 'provider_error' WHEN h >= 400 THEN 'rejected' WHEN trim(b) = '' THEN 'empty'
    WHEN NOT json_valid(b) THEN 'invalid_json' WHEN json_extract_string(b, '$.refusal') IS NOT NULL THEN 'refused' WHEN json_extract_string(b, '$.label') IS NULL THEN 'missing_label' WHEN json_extract_string(b, '$.label') NOT IN ('clean', 'ungrounded', 'contradicted', 'unclear') THEN 'unknown_label' WHEN json_extract_string(b, '$.label') = 'unclear' THEN 'unclear' ELSE 'valid' END AS status, count(*) AS n FROM x GROUP BY 1""")
def judge_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    http = F.get(F.array(*[F.lit(v) for v in (200, 200, 200, 429, 500, 401, 402, 404)]), (i % 8).cast("int"))
    e = views.table(spark, sf_dir, "events").select(detail.response_status(http, views.pick(_BODIES, i % 7)).alias("status"))
    return e.groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE ('0x' || left(sha256('0|' || event_id::VARCHAR), 8))::BIGINT < 214748364")
def shadow_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five per cent of requests, chosen by hash: a sampling operator."""
    return views.table(spark, sf_dir, "events").filter(detail.sampled(F.col("event_id"), 0.05)).select("event_id")


@query("SELECT user_id, sha256(string_agg('{\"event_id\":' || event_id::VARCHAR || ',\"event_type\":\"' || event_type || '\"}', chr(10) ORDER BY event_id)) AS digest FROM events GROUP BY 1")
def rows_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail.rows_digest(views.table(spark, sf_dir, "events"), "user_id", "event_id", ["event_id", "event_type"])


@query("SELECT event_id, round(CASE WHEN event_id % 3 > 0 THEN value / 100 + (event_id % 4) * 0.02::DOUBLE ELSE greatest(0.02::DOUBLE, value / 1000) * (event_id % 4 + 1) END, 6) AS usd FROM events")
def accounted_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    cost = detail.accounted(F.when(i % 3 > 0, v / 100), i % 4 + 1, F.lit(0.02), v / 1000)
    return views.table(spark, sf_dir, "events").select("event_id", F.round(cost, 6).alias("usd"))


@query(views.sql(f"WITH {_STAKES}, {_priced_sql()} SELECT r.request_id, d.n AS decisions, d.first AS cheapest, s.n AS spend_rows, s.tokens FROM v_requests r JOIN (SELECT request_id, count(*) AS n, arg_min(action, ladder) AS first FROM v_priced GROUP BY 1) d USING (request_id) JOIN (SELECT request_id, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM v_spend GROUP BY 1) s USING (request_id)", "v_requests", "v_spend"))
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = decide.priced_actions(_items(spark, sf_dir), "request_id").select("request_id", "ladder", "action", "total")
    e = detail.evidence_rows(views.requests(spark, sf_dir).select("request_id"), priced, views.spend(spark, sf_dir))
    tokens = F.aggregate("spend", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return e.select("request_id", F.size("decisions").cast("long").alias("decisions"), F.get("decisions", F.lit(0))["action"].alias("cheapest"), F.size("spend").cast("long").alias("spend_rows"), tokens.alias("tokens"))


_QUESTIONS = ("Compare the loan and the mortgage", "What is the transfer fee?", "If I prepay Rs. 2,50,000 now, how much interest do I save?", "Hello", "Claim of 3 lakh: can I settle, or of 1.5 crore?", "Branch timing and address; and also the ATM")


@query("""SELECT event_id, domain, difficulty, amount FROM events JOIN (VALUES (0, 'loan_terms', 0.9::DOUBLE, 0::DOUBLE), (1, 'fees', 5 / 60::DOUBLE, 0), (2, 'prepayment', 0.7, 250000), (3, 'general', 1 / 60::DOUBLE, 0), (4, 'claims', 11 / 60::DOUBLE, 15000000),
    (5, 'branch_info', 0.8, 0)) AS t(i, domain, difficulty, amount) ON i = event_id % 6""")
def question_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.pick(_QUESTIONS, F.col("event_id") % 6)
    e = views.table(spark, sf_dir, "events").select("event_id", q.alias("q"))
    return e.select("event_id", text.intent(F.col("q")).alias("domain"), text.difficulty(F.col("q"), F.lit(False)).alias("difficulty"), text.largest_amount(F.col("q")).alias("amount"))


@query("SELECT doc_id, ntile(3) OVER (PARTITION BY source ORDER BY doc_id)::INT AS level FROM documents")
def level_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    return views.table(spark, sf_dir, "documents").select("doc_id", F.ntile(3).over(Window.partitionBy("source").orderBy("doc_id")).alias("level"))


@query()
def probe_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.table(spark, sf_dir, "embeddings")
    mean, scale, weights, bias, area = detail.probe_fit(v, F.col("label") < 5)
    return measure.probe_scores(v, mean, scale, weights, bias).withColumn("held_out_auroc", F.lit(area))
