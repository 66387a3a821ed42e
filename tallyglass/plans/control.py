"""Registered queries of what surrounds a decision, with their SQL. The SQL states its own values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass import policy, views
from tallyglass.functions import text
from tallyglass.operators import control, measure
from tallyglass.plans.ledger import _STAKES, _stakes
from tallyglass.plans.text import _CONTENT

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _at(values: tuple[str, ...], index: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({index} + 1)::INT]"


# -- gate and governor -----------------------------------------------------------------------------------------------


@query(views.sql("""SELECT request_id, CASE WHEN degraded OR ttft_ms * 15 > 8000 THEN 'released' WHEN k % 3 = 0 THEN 'L2_repair' ELSE 'L0_pass' END AS outcome,
    CASE WHEN degraded THEN 'verdict failed' WHEN ttft_ms * 15 > 8000 THEN 'verdict timed out' ELSE '' END AS note FROM v_requests""", "v_requests"))
def verdict_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.requests(spark, sf_dir)
    action = F.when(F.col("k") % 3 == 0, "L2_repair").otherwise("L0_pass")
    return r.select("request_id", control.verdict_outcome(F.col("ttft_ms") * 15, F.col("degraded"), action).alias("v")).select("request_id", "v.*")


@query(views.sql("""SELECT session_id, request_id, CASE WHEN bool_or(k > 90 OR degraded) OVER (PARTITION BY session_id ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) THEN 'buffered' ELSE 'passthrough' END AS mode
    FROM v_requests""", "v_requests"))
def gate_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.requests(spark, sf_dir)
    return control.escalated(r, ["session_id"], ["ts", "request_id"], (F.col("k") > 90) | F.col("degraded")).select("session_id", "request_id", "mode")


@query(views.sql(f"WITH {_STAKES} SELECT request_id, CASE WHEN impact_inr >= 1000 THEN 'L4_hold' ELSE 'L0_pass' END AS action FROM v_stakes", "v_requests"))
def bypass_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stakes(spark, sf_dir).select("request_id", control.bypass_action(F.col("impact_inr")).alias("action"))


@query(views.sql("""SELECT request_id, CASE WHEN k % 4 = 0 THEN 'closed' WHEN k % 61 >= 30 THEN 'half_open' ELSE 'open' END AS state FROM v_requests""", "v_requests"))
def breaker_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that a breaker is in by the clock alone: opened some seconds ago, or never."""
    k, i = F.col("k"), F.col("request_id").cast("double")
    return views.requests(spark, sf_dir).select("request_id", control.breaker_state(i + k % 61, F.when(k % 4 != 0, i)).alias("state"))


# -- before the answer -----------------------------------------------------------------------------------------------

_DETECTORS = ("canary", "injection", "pii")
_RACE = """v_race AS (SELECT request_id, name, CASE WHEN latency_ms > 250 THEN 'late' WHEN failed THEN 'failed' ELSE 'done' END AS status, raw, prob FROM (
    SELECT request_id, d AS name, ((request_id * 31 + i * 97) % 400)::DOUBLE AS latency_ms, (k + i) % 17 = 0 AS failed, ((k + i) % 10)::DOUBLE / 10.0::DOUBLE AS raw, p_ungrounded AS prob
    FROM v_requests, (VALUES ('canary', 0), ('injection', 1), ('pii', 2)) AS t(d, i)))"""


def _raced(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.posexplode(F.array(*[F.lit(d) for d in _DETECTORS])).alias("i", "name")
    r = views.requests(spark, sf_dir).select("request_id", "k", "p_ungrounded", each)
    i, k = F.col("i"), F.col("k")
    return control.raced(r.select(
        "request_id", "name", ((F.col("request_id") * 31 + i * 97) % 400).cast("double").alias("latency_ms"), ((k + i) % 17 == 0).alias("failed"), ((k + i) % 10 / 10.0).alias("raw"), F.col("p_ungrounded").alias("prob"),
    ))


@query(views.sql(f"WITH {_RACE} SELECT request_id, name, status, CASE WHEN status = 'done' THEN raw ELSE 0 END::DOUBLE AS raw, CASE WHEN status = 'done' THEN prob END AS prob FROM v_race", "v_requests"))
def preflight_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raced(spark, sf_dir).select("request_id", "name", "status", "raw", "prob")


@query(views.sql(f"WITH {_RACE} SELECT request_id, coalesce(string_agg(CASE WHEN status <> 'done' THEN name END, ',' ORDER BY name), '') AS dropped FROM v_race GROUP BY 1", "v_requests"))
def preflight_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.dropped(_raced(spark, sf_dir), "request_id")


@query(views.sql(f"""WITH {_STAKES}, {_RACE}, d AS (SELECT request_id, count_if(status <> 'done')::BIGINT AS n_dropped, max(CASE WHEN status = 'done' AND name = 'injection' THEN raw ELSE 0 END) AS injection FROM v_race GROUP BY 1)
    SELECT s.request_id, CASE WHEN s.degraded OR impact_inr >= 1000 OR p_overconfident >= 0.65 THEN 'strong' ELSE 'cheap' END AS tier, CASE WHEN impact_inr >= 1000 OR injection >= 0.6 THEN 'buffered' ELSE 'passthrough' END AS gate_mode,
    CASE WHEN injection >= 0.6 THEN 'retrieved_untrusted' ELSE 'retrieved_verified' END AS provenance, n_dropped FROM v_stakes s JOIN d ON d.request_id = s.request_id""", "v_requests"))
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stakes, detectors under their deadline, relabelling and route, composed."""
    from tallyglass.operators import decide

    done = F.when((F.col("status") == "done") & (F.col("name") == "injection"), F.col("raw")).otherwise(0.0)
    read = _raced(spark, sf_dir).groupBy("request_id").agg(F.count_if(F.col("status") != "done").alias("n_dropped"), F.max(done).alias("injection"))
    s = _stakes(spark, sf_dir).join(read, "request_id")
    gate = F.when(F.col("injection") >= 0.6, "buffered").otherwise(decide.gate_mode(F.col("impact_inr")))
    return s.select("request_id", decide.tier(F.col("impact_inr"), F.col("p_overconfident"), F.col("degraded")).alias("tier"), gate.alias("gate_mode"), text.relabelled(F.lit("retrieved_verified"), F.col("injection")).alias("provenance"), "n_dropped")


@query("""WITH f AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS domain FROM events), c AS (SELECT user_id, domain, count(*) AS n, min(event_id) AS first FROM f WHERE domain IS NOT NULL GROUP BY 1, 2),
    b AS (SELECT user_id, domain, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS r FROM c) SELECT u.user_id, coalesce(b.domain, 'general') AS domain FROM (SELECT DISTINCT user_id FROM f) u LEFT JOIN b ON b.user_id = u.user_id AND r = 1""")
def retrieved_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("domain"))
    return control.top_domain(e, "user_id", "event_id")


@query(f"""WITH c AS (SELECT user_id, {_at(views.TOOLS, 'event_id % 5')} AS tool FROM events),
    k AS (SELECT user_id, tool, CASE tool WHEN 'lookup_balance' THEN 0 WHEN 'raise_ticket' THEN 1 WHEN 'send_email' THEN 2 WHEN 'transfer_funds' THEN 2 ELSE 1 END AS r FROM c),
    b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC, tool) AS n FROM (SELECT DISTINCT * FROM k)) SELECT user_id, tool, ['reversible', 'costly', 'irreversible'][r + 1] AS reversibility FROM b WHERE n = 1""")
def worst_reachable_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select("user_id", views.pick(views.TOOLS, F.col("event_id") % 5).alias("tool"))
    return control.worst_tool(e, "user_id", policy.tools(spark).select("tool", "reversibility"))


@query(f"""WITH m AS (SELECT event_id, {_at(views.MODELS, 'event_id % 6')} AS a, {_at(views.MODELS, 'event_id // 6 % 6')} AS b FROM events),
    p AS (SELECT * FROM (VALUES ('qwen3:4b', 0.42), ('qwen3:8b', 0.9), ('gpt-4o', 0.252), ('claude-sonnet-4', 0.3276), ('gpt-4o-mini-2024', 0.9), ('mystery-1', 0.9)) AS t(m, c))
    SELECT event_id, CASE WHEN x.c <= y.c THEN a ELSE b END AS model FROM m JOIN p x ON x.m = a JOIN p y ON y.m = b""")
def cheaper_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    pick = lambda at: views.pick(views.MODELS, at)
    return views.table(spark, sf_dir, "events").select("event_id", control.cheaper(pick(i % 6), pick(F.expr("event_id div 6") % 6)).alias("model"))


# -- claims ----------------------------------------------------------------------------------------------------------

_VERDICTS = f"""v_claims AS (SELECT conv_id, turn AS claim_id, text AS claim FROM conversations WHERE role = 'assistant'), v_passages AS (SELECT conv_id, turn AS passage_id, text AS passage FROM conversations WHERE role = 'user' AND (conv_id + turn) % 7 <> 0 AND trim(text) <> ''),
    w AS MATERIALIZED (SELECT conv_id, claim_id, list_distinct({_CONTENT('claim')}) AS cw FROM v_claims), u AS MATERIALIZED (SELECT conv_id, passage_id, list_distinct({_CONTENT('passage')}) AS pw FROM v_passages),
    s AS (SELECT w.conv_id, claim_id, passage_id, round(CASE WHEN len(cw) = 0 THEN 0 ELSE len(list_intersect(cw, pw))::DOUBLE / len(cw) END, 9)::DOUBLE AS support FROM w JOIN u ON u.conv_id = w.conv_id),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, claim_id ORDER BY support DESC, passage_id) AS r FROM s) WHERE r = 1),
    v AS (SELECT c.conv_id, c.claim_id, b.support, b.passage_id AS evidence_id, CASE WHEN b.support IS NULL THEN 'unjudged' WHEN b.support >= 0.5 THEN 'supported' ELSE 'contradicted' END AS label FROM v_claims c LEFT JOIN b ON b.conv_id = c.conv_id AND b.claim_id = c.claim_id)"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "conversations")
    claims = c.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("claim_id"), F.col("text").alias("claim"))
    provenance = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, "retrieved_untrusted").otherwise("retrieved_verified")
    passages = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("passage_id"), F.col("text").alias("passage"), provenance.alias("provenance"))
    return control.claim_verdicts(claims, passages, "conv_id")


@query(f"WITH {_VERDICTS} SELECT conv_id, claim_id, support, evidence_id, label FROM v")
def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("conv_id", "claim_id", "support", "evidence_id", "label")


@query(f"""WITH {_VERDICTS}, j AS (SELECT conv_id, claim_id, support, row_number() OVER (PARTITION BY conv_id ORDER BY support, claim_id) AS r FROM v WHERE support IS NOT NULL)
    SELECT x.conv_id, j.claim_id AS worst_claim, j.support, x.any_unsupported, x.unjudged FROM (SELECT conv_id, bool_or(label = 'contradicted') AS any_unsupported, count_if(label = 'unjudged')::BIGINT AS unjudged FROM v GROUP BY 1) x
    LEFT JOIN j ON j.conv_id = x.conv_id AND j.r = 1""")
def least_supported_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.least_supported(_verdicts(spark, sf_dir), "conv_id")


@query("SELECT conv_id, turn, CASE WHEN length(text) >= 20 AND turn % 3 <> 2 THEN greatest(0, least(1, (conv_id % 13)::DOUBLE / 10 - 0.1::DOUBLE)) END::DOUBLE AS p FROM conversations")
def observer_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    premise = F.when(F.col("turn") % 3 == 2, " ").otherwise("a premise")
    return views.table(spark, sf_dir, "conversations").select("conv_id", "turn", control.observer_reading(F.col("conv_id") % 13 / 10.0 - 0.1, F.col("text"), premise).alias("p"))


# -- pairs and caches ------------------------------------------------------------------------------------------------


@query(views.sql("""WITH x AS (SELECT request_id, k, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS approved, [k % 4] AS amounts, [k % 2] AS percentages, event_type AS action, k % 6 AS hedges FROM v_requests)
    SELECT a.request_id AS pair_id, array_to_string(list_filter([CASE WHEN a.approved <> b.approved THEN 'approved' END, CASE WHEN a.amounts <> b.amounts THEN 'amounts' END, CASE WHEN a.percentages <> b.percentages THEN 'percentages' END,
    CASE WHEN a.action <> b.action THEN 'action' END, CASE WHEN abs(a.hedges - b.hedges) >= 2 THEN 'hedging' END], lambda d: d IS NOT NULL), ',') AS differences FROM x a JOIN x b ON b.request_id = a.request_id + 1""", "v_requests"))
def twin_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    fields = F.struct(F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("approved"), F.array(k % 4).alias("amounts"), F.array(k % 2).alias("percentages"), F.col("event_type").alias("action"), (k % 6).alias("hedges"))
    x = views.requests(spark, sf_dir).select("request_id", fields.alias("f"))
    a, b = x.alias("a"), x.select((F.col("request_id") - 1).alias("request_id"), F.col("f").alias("g")).alias("b")
    return a.join(b, "request_id").select(F.col("request_id").alias("pair_id"), F.array_join(control.twin_differences(F.col("f"), F.col("g")), ",").alias("differences"))


@query("""SELECT conv_id, 'sha256:' || sha256('[' || string_agg(to_json({'provenance': CASE WHEN role = 'user' THEN 'user' ELSE 'retrieved_verified' END, 'text': text})::VARCHAR, ',' ORDER BY turn) || ']') AS digest FROM conversations GROUP BY 1""")
def context_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests that depend on order and provenance."""
    f = F.struct("turn", F.when(F.col("role") == "user", "user").otherwise("retrieved_verified").alias("provenance"), "text")
    return views.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(f)).alias("f")).select("conv_id", control.context_digest(F.col("f")).alias("digest"))


@query(views.sql("""SELECT session_id, bool_and(k % 9 <> 0) AND NOT bool_or(degraded) AND session_id % 10 <> 0 AS cacheable FROM v_requests GROUP BY 1""", "v_requests"))
def cache_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = F.collect_list(F.when(F.col("k") % 9 == 0, "L2_repair").otherwise("L0_pass"))
    s = views.requests(spark, sf_dir).groupBy("session_id").agg(actions.alias("actions"), F.bool_or("degraded").alias("degraded"))
    answer = F.when(F.col("session_id") % 10 != 0, "an answer")
    return s.select("session_id", control.cacheable(F.col("actions"), F.col("degraded"), F.lit("a question"), answer).alias("cacheable"))


_MISSES = ("similarity 0.91 below 0.95; nearest kept", "stakes above ceiling -- Rs.40,000", "context changed; digest differs -- twice", "  cold  ")


@query(f"""SELECT left(trim(split_part(split_part(m, ';', 1), '--', 1)), 60) AS bucket, count(*) AS n FROM (SELECT {_at(_MISSES, 'event_id % 4')} || CASE WHEN event_id % 8 = 3 THEN '; again' ELSE '' END AS m FROM events) GROUP BY 1""")
def cache_miss_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    reason = F.concat(views.pick(_MISSES, i % 4), F.when(i % 8 == 3, "; again").otherwise(""))
    return control.miss_reasons(views.table(spark, sf_dir, "events").select(reason.alias("reason")))


@query(views.sql("""SELECT request_id, sha256('model=' || model || chr(1) || 'n=' || k::VARCHAR || chr(1) || 'user=' || session_id::VARCHAR) AS digest FROM v_requests""", "v_requests"))
def scope_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = F.create_map(F.lit("user"), F.col("session_id").cast("string"), F.lit("stream"), (F.col("k") % 2).cast("string"), F.lit("n"), F.col("k").cast("string"), F.lit("model"), F.col("model"))
    return views.requests(spark, sf_dir).select("request_id", control.scope_digest(request).alias("digest"))


@query("SELECT source, sha256(string_agg(sha256(doc_id::VARCHAR || '|' || coalesce(lang, '')), chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY 1")
def dataset_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.coalesce("lang", F.lit("")))
    return control.rows_digest(views.table(spark, sf_dir, "documents"), ["source"], "doc_id", line)


# -- fallbacks, economics, shapes ------------------------------------------------------------------------------------


@query(views.sql("SELECT request_id, k > 40 AND NOT cache_hit AND degraded AND model = 'qwen3:8b' AS may_fall_back FROM v_requests", "v_requests"))
def capacity_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("k") > 40, "strong").otherwise("cheap")
    return views.requests(spark, sf_dir).select("request_id", control.may_fall_back(tier, F.col("cache_hit"), F.col("degraded"), F.col("model")).alias("may_fall_back"))


@query(views.sql("""WITH x AS (SELECT session_id, count(*) AS n, count_if(k > 20)::BIGINT AS samples, sum(CASE WHEN k > 20 THEN k END) AS net, sum(CASE WHEN k > 60 THEN 1 END) AS regret, sum(CASE WHEN k % 4 = 0 THEN 1 END) AS rework FROM v_requests GROUP BY 1)
    SELECT session_id, CASE WHEN regret IS NULL AND rework IS NULL THEN 'regret and rework measurements are unavailable' WHEN regret IS NULL THEN 'regret measurements are unavailable' WHEN rework IS NULL THEN 'rework measurements are unavailable'
    WHEN samples > 0 AND net IS NOT NULL THEN '' ELSE 'no request-level net-value samples are available' END AS reason FROM x""", "v_requests"))
def economics_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    x = views.requests(spark, sf_dir).groupBy("session_id").agg(
        F.count("*").alias("n"), F.count_if(k > 20).alias("samples"), F.sum(F.when(k > 20, k)).alias("net"), F.sum(F.when(k > 60, 1)).alias("regret"), F.sum(F.when(k % 4 == 0, 1)).alias("rework")
    )
    return x.select("session_id", control.economics_reason(F.col("n"), F.col("samples"), F.col("net"), F.col("regret"), F.col("rework")).alias("reason"))


@query(views.sql("""SELECT request_id AS decision_id, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 0 ELSE k::DOUBLE / 100 END AS p_ungrounded, CASE WHEN k % 3 = 0 THEN 0 ELSE 2 END::INT AS n_why, CASE WHEN k % 2 = 0 THEN '' ELSE 'v' || (k % 7)::VARCHAR END AS policy_version,
    CASE WHEN k % 4 = 0 THEN 0 ELSE overhead_ms END AS latency_ms FROM v_requests""", "v_requests"))
def decision_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    probs = F.when(k % 5 == 0, None).when(k % 5 == 1, '{"ungrounded": 0}').otherwise(F.to_json(F.struct((k / 100.0).alias("ungrounded"))))
    d = views.requests(spark, sf_dir).select(
        F.col("request_id").alias("decision_id"), probs.alias("probs_json"), F.when(k % 3 != 0, '["one", "two"]').alias("why_json"), F.when(k % 2 != 0, F.concat(F.lit("v"), (k % 7).cast("string"))).alias("policy_version"),
        F.lit(None).cast("string").alias("calib_version"), F.lit(None).cast("string").alias("inputs_digest"), F.when(k % 4 != 0, F.col("overhead_ms")).alias("latency_ms"),
    )
    return control.decision_detail(d).select("decision_id", F.try_element_at("probs", F.lit("ungrounded")).alias("p_ungrounded"), F.size("why").alias("n_why"), "policy_version", "latency_ms")


@query(views.sql("""WITH h AS (SELECT request_id AS hold_id, CASE WHEN k % 2 = 0 THEN 'response' ELSE 'tool' END AS kind, CASE WHEN k % 3 = 0 THEN 'approved' ELSE 'pending' END AS state, 'k' || (k % 4)::VARCHAR AS reason, request_id::DOUBLE AS created_ts, CASE WHEN k % 5 > 1 THEN request_id::DOUBLE + k END AS d FROM v_requests)
    SELECT hold_id, kind, state, reason, created_ts, coalesce(d, CASE WHEN kind = 'response' THEN created_ts + 900 END) AS deadline_ts, coalesce(2000 > coalesce(d, CASE WHEN kind = 'response' THEN created_ts + 900 END), false) AS expired FROM h WHERE state = 'pending'""", "v_requests"))
def review_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, i = F.col("k"), F.col("request_id").cast("double")
    h = views.requests(spark, sf_dir).select(
        F.col("request_id").alias("hold_id"), F.when(k % 2 == 0, "response").otherwise("tool").alias("kind"), F.when(k % 3 == 0, "approved").otherwise("pending").alias("state"), F.concat(F.lit("k"), (k % 4).cast("string")).alias("reason"),
        i.alias("created_ts"), F.when(k % 5 > 1, i + k).alias("sla_deadline_ts"), F.lit("secret").alias("resume_token"),
    )
    return control.review_cards(h, 2000.0)


@query("SELECT event_id, event_id % 5 <> 0 AND CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN event_type = 'view' ELSE false END AS rides FROM events")
def stream_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    name = F.when(i % 3 == 0, "signal").when(i % 3 == 1, "hold").otherwise("chatter")
    chosen = F.when(F.col("event_type") == "view", F.array(F.lit("signal"), F.lit("hold"), F.lit("chatter"))).otherwise(F.array(F.lit("signal"), F.lit("chatter")))
    return views.table(spark, sf_dir, "events").select("event_id", control.stream_allows(name, i % 5 != 0, chosen).alias("rides"))


@query(views.sql("SELECT doc_id FROM v_fragments WHERE ends_with(provenance, 'untrusted')", "v_fragments"))
def untrusted_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.fragments(spark, sf_dir).filter(F.endswith("provenance", F.lit("untrusted"))).select("doc_id")


@query(views.sql("SELECT request_id, 'L0_pass' AS action, 0::DOUBLE AS chosen_loss, 'degraded: ' || model AS why, true AS degraded FROM v_requests WHERE degraded", "v_requests"))
def degraded_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.requests(spark, sf_dir).filter("degraded").select("request_id", control.degraded_decision(F.col("model")).alias("d")).select("request_id", "d.*")


@query(views.sql("""SELECT request_id, CASE WHEN k % 4 IN (0, 2) THEN p_ungrounded END AS p_ungrounded, CASE WHEN k % 4 >= 2 THEN p_contradicted END AS p_contradicted, k % 4 <> 2 AS degraded FROM v_requests""", "v_requests"))
def calibrated_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    raw = F.create_map(F.lit("ungrounded"), F.col("p_ungrounded"), F.lit("contradicted"), F.col("p_contradicted"))
    known = F.when(k % 4 == 0, F.array(F.lit("ungrounded"))).when(k % 4 == 1, F.array().cast("array<string>")).when(k % 4 == 2, F.array(F.lit("ungrounded"), F.lit("contradicted"))).otherwise(F.array(F.lit("contradicted")))
    c = views.requests(spark, sf_dir).select("request_id", control.calibrated(raw, known).alias("c"))
    return c.select("request_id", *[F.try_element_at("c.probs", F.lit(d)).alias(f"p_{d}") for d in ("ungrounded", "contradicted")], "c.degraded")


@query(views.sql("""SELECT request_id, CASE WHEN k % 3 = 0 THEN array_to_string(list_filter([CASE WHEN k % 2 = 0 THEN 'cites Clause ' || k::VARCHAR || ', Clause 4.2, which is not in the retrieved context' END, CASE WHEN k % 4 <> 1 THEN 'states the figure(s) ' || (k * 2)::VARCHAR || ', which appear nowhere in the retrieved context' END], lambda c: c IS NOT NULL), '; ') END AS claims,
    CASE WHEN k % 3 = 0 THEN least(3, k % 5) END::INT AS n_evidence FROM v_requests""", "v_requests"))
def repair_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    none = F.array().cast("array<string>")
    hint = control.repair_hint(
        F.when(k % 3 == 0, "L2_repair").otherwise("L0_pass"), F.when(k % 2 == 0, F.array(k.cast("string"), F.lit("4.2"))).otherwise(none), F.when(k % 4 != 1, F.array((k * 2).cast("string"))).otherwise(none),
        F.slice(F.array(*[F.lit(f"p{i}") for i in range(5)]), F.lit(1), (k % 5).cast("int")),
    )
    return views.requests(spark, sf_dir).select("request_id", hint.alias("h")).select("request_id", F.array_join("h.claims", "; ").alias("claims"), F.when(F.col("h").isNotNull(), F.size("h.evidence")).alias("n_evidence"))


@query("SELECT i, round((1 - s) + d + (n - 1) / 50.0::DOUBLE, 9) AS distance FROM (SELECT event_id AS i, (event_id % 5)::DOUBLE / 5 AS s, (event_id % 7)::DOUBLE / 100 AS d, (event_id % 30)::DOUBLE AS n FROM events)")
def policy_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return views.table(spark, sf_dir, "events").select(i.alias("i"), F.round(control.policy_distance(i % 5 / 5.0, i % 7 / 100.0, (i % 30).cast("double")), 9).alias("distance"))


# -- tools and prompts -----------------------------------------------------------------------------------------------

_CALLS = """v_calls AS (SELECT event_id, CASE k % 6 WHEN 0 THEN '{"amount": "Rs.' || k::VARCHAR || ',500", "to": "x"}' WHEN 1 THEN '{"total": ' || k::VARCHAR || ', "sum": true}' WHEN 2 THEN '[' || k::VARCHAR || ', 2]' WHEN 3 THEN '{"amount": ' WHEN 4 THEN ' ' ELSE '{"value": "many", "sum": "' || k::VARCHAR || '.5"}' END AS args,
    k FROM (SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events))"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k").cast("string")
    m = F.col("k") % 6
    args = (
        F.when(m == 0, F.concat(F.lit('{"amount": "Rs.'), k, F.lit(',500", "to": "x"}'))).when(m == 1, F.concat(F.lit('{"total": '), k, F.lit(', "sum": true}'))).when(m == 2, F.concat(F.lit("["), k, F.lit(", 2]")))
        .when(m == 3, '{"amount": ').when(m == 4, " ").otherwise(F.concat(F.lit('{"value": "many", "sum": "'), k, F.lit('.5"}')))
    )
    e = views.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.select("event_id", "k", control.call_arguments(args).alias("c"))


@query(f"WITH {_CALLS} SELECT event_id, CASE WHEN trim(args) = '' THEN 'none' WHEN NOT json_valid(args) THEN 'unparsed' WHEN json_type(args) = 'OBJECT' THEN 'object' ELSE 'value' END AS kind FROM v_calls")
def parsed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("event_id", "c.kind")


@query(f"WITH {_CALLS} SELECT event_id, CASE k % 6 WHEN 0 THEN (k::VARCHAR || '500')::DOUBLE WHEN 1 THEN k::DOUBLE WHEN 5 THEN k + 0.5 END::DOUBLE AS amount FROM v_calls")
def declared_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("event_id", control.declared_amount(F.col("c.arguments")).alias("amount"))


@query("""SELECT user_id, array_to_string(list_concat(l[1:6], CASE WHEN len(l) > 6 THEN ['... +' || (len(l) - 6)::VARCHAR || ' more'] ELSE [] END), ', ') AS summary FROM (SELECT user_id, list(event_type || '=' || event_id::VARCHAR ORDER BY event_id) AS l FROM events GROUP BY 1)""")
def argument_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("a"))
    names, values = F.transform("a", lambda x: x["event_type"]), F.transform("a", lambda x: x["event_id"].cast("string"))
    return a.select("user_id", control.argument_summary(names, values).alias("summary"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'do it' WHEN 1 THEN 'look_up' WHEN 2 THEN '' ELSE 'send' END AS tool FROM events""")
def tool_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = views.pick(('{"type": "function", "function": {"name": " do it "}}', '{"name": "look_up"}', "{}", '{"name": "other", "function": {"name": "send"}}'), F.col("event_id") % 4)
    return views.table(spark, sf_dir, "events").select("event_id", control.tool_name(wire).alias("tool"))


_COMPLETIONS = ("<think>no</think>\n\nAnswer: \"It is 5%.\"\nMore", "It is so.", "<THINKING >cut off", "  \n Correction: \"\"Yes\"\" ", "</think>Corrected sentence: the fee is 20")
_TIDY = ("It is 5%.", "It is so.", "", "Yes", "the fee is 20")


@query(f"SELECT event_id, {_at(_TIDY, 'event_id % 5')} || CASE WHEN event_id % 5 = 1 THEN ' Case ' || event_id::VARCHAR ELSE '' END AS answer FROM events")
def tidied_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(views.pick(_COMPLETIONS, F.col("event_id") % 5), F.when(F.col("event_id") % 5 == 1, F.concat(F.lit(" Case "), F.col("event_id").cast("string"))).otherwise(""))
    return views.table(spark, sf_dir, "events").select("event_id", control.tidied(raw).alias("answer"))


@query("SELECT doc_id, CASE WHEN length(s) > 20 THEN left(s, 12) || '...' || right(s, 4) ELSE left(s, 4) || '...' END AS short FROM (SELECT doc_id, 'IL-CANARY-' || repeat('x', (doc_id % 20)::INT) || doc_id::VARCHAR AS s FROM documents)")
def short_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit("IL-CANARY-"), F.expr("repeat('x', cast(doc_id % 20 as int))"), F.col("doc_id").cast("string"))
    return views.table(spark, sf_dir, "documents").select("doc_id", control.short_secret(s).alias("short"))


@query("SELECT conv_id, turn, greatest(1, length(text) // 4)::INT AS guessed, (octet_length(encode(text)) + 512)::INT AS most FROM conversations")
def token_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "conversations").select("conv_id", "turn", control.guessed_tokens(F.col("text")).alias("guessed"), control.most_tokens(F.col("text")).alias("most"))


# -- anchors, splits, probes -----------------------------------------------------------------------------------------


@query("SELECT event_id, CASE event_id % 3 WHEN 1 THEN 'ungrounded' WHEN 2 THEN 'contradicted' ELSE 'clean' END AS gold FROM events")
def gold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return views.table(spark, sf_dir, "events").select("event_id", control.gold_label((i % 3 == 1).cast("int"), (i % 3 == 2).cast("int")).alias("gold"))


@query("""WITH a AS (SELECT l.doc_id, d.source, d.lang, l.quality, l.toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
    SELECT source, lang, quality, count(*) AS n, count_if(quality = 1 AND toxic = 0)::BIGINT AS clean FROM a GROUP BY GROUPING SETS ((source), (lang), (quality), ())""")
def anchor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.table(spark, sf_dir, "labels").join(views.table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    sets = [[F.col("source")], [F.col("lang")], [F.col("quality")], []]
    return a.groupingSets(sets, "source", "lang", "quality").agg(F.count("*").alias("n"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean"))


@query(views.sql("SELECT v.doc_id FROM v_fragments v WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = v.doc_id)", "v_fragments"))
def items_still_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed run still has to do: everything selected that has no result yet."""
    return views.fragments(spark, sf_dir).select("doc_id").join(views.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT a.doc_id AS item_id, b.doc_id AS partner_id, b.source AS partner_source FROM (SELECT doc_id, doc_id - 1 AS contradicts FROM documents) a JOIN documents b ON b.doc_id = a.contradicts""")
def contradiction_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select("doc_id", "source")
    partner = d.select(F.col("doc_id").alias("partner_id"), F.col("source").alias("partner_source"))
    return d.select(F.col("doc_id").alias("item_id"), (F.col("doc_id") - 1).alias("partner_id")).join(partner, "partner_id").select("item_id", "partner_id", "partner_source")


@query("""WITH k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS k FROM documents), s AS (SELECT source, count(*) AS size, row_number() OVER (ORDER BY source) - 1 AS d FROM documents GROUP BY 1),
    h AS (SELECT k.doc_id, k.k, s.d FROM k JOIN s ON s.source IS NOT DISTINCT FROM k.source), n AS (SELECT count(*) AS n FROM s),
    a AS (SELECT h.doc_id, r.rank, (h.d + r.rank) % n.n AS d, h.k FROM h, n, (VALUES (1), (2)) AS r(rank) WHERE r.rank < n.n)
    SELECT a.doc_id, a.rank::INT AS rank, h.doc_id AS distractor_id FROM a JOIN s ON s.d = a.d JOIN h ON h.d = a.d AND h.k = a.k % s.size""")
def distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.distractors(views.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("domain")))


@query("""WITH c AS (SELECT user_id % 3 AS probe, user_id % 12 AS layer, 0.5 + count_if(event_type = 'view')::DOUBLE / count(*) / 3 AS auroc, 40::DOUBLE AS pos, 160::DOUBLE AS neg FROM events GROUP BY 1, 2),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY auroc DESC, layer) AS r FROM c) WHERE r = 1),
    e AS (SELECT probe, auroc AS best, auroc - sqrt(greatest(0, (auroc * (1 - auroc) + (pos - 1) * (auroc / (2 - auroc) - auroc * auroc) + (neg - 1) * (2 * auroc * auroc / (1 + auroc) - auroc * auroc)) / (pos * neg))) AS least FROM t)
    SELECT c.probe, round(e.best, 9) AS best_auroc, min(c.layer) AS layer FROM c JOIN e ON e.probe = c.probe WHERE c.auroc >= e.least GROUP BY 1, 2""")
def probe_layer_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).alias("probe"), (F.col("user_id") % 12).alias("layer"))
    curve = e.agg((0.5 + F.count_if(F.col("event_type") == "view") / F.count("*") / 3).alias("auroc")).withColumns({"pos": F.lit(40.0), "neg": F.lit(160.0)})
    return control.earliest_layer(curve, ["probe"]).withColumn("best_auroc", F.round("best_auroc", 9))


@query("""SELECT defect, sum(y)::BIGINT AS positives, CASE WHEN sum(y) < 30 THEN 'only ' || sum(y)::VARCHAR || ' positives (need 30)' ELSE 'fitted' END AS note FROM (SELECT doc_id, 'toxic' AS defect, toxic AS y FROM labels UNION ALL SELECT doc_id, 'low_quality', 1 - quality FROM labels
    UNION ALL SELECT doc_id, 'both', toxic * (1 - quality) FROM labels) GROUP BY 1""")
def one_vs_rest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"toxic": F.col("toxic"), "low_quality": 1 - F.col("quality"), "both": F.col("toxic") * (1 - F.col("quality"))}
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), y.alias("y")) for d, y in kinds.items()]))
    return control.fit_plan(views.table(spark, sf_dir, "labels").select(rows.alias("r")).select("r.*"))


@query()
def one_vs_rest_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrator for each defect with enough positives, applied to every labelled document."""
    s = views.scored(spark, sf_dir).select("doc_id", "p", "y", "y2", (F.col("y2") * 0.4 + F.pmod(F.xxhash64("doc_id"), F.lit(600)) / 1000.0).alias("signal"))
    fitted = {r["defect"] for r in one_vs_rest_plan(spark, sf_dir).filter("note = 'fitted'").collect()}
    columns = {d: measure.Calibrator.fit(s, ["signal", "p"], y).probability().alias(f"p_{d}") for d, y in (("toxic", "y"), ("low_quality", "y2")) if d in fitted}
    return s.select("doc_id", *columns.values())


@query("""SELECT count(*) = 0 AS disjoint FROM (SELECT doc_id FROM documents WHERE doc_id % 5 < 3 INTERSECT SELECT doc_id FROM documents WHERE doc_id % 5 >= 3)""")
def splits_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select("doc_id")
    both = d.filter("doc_id % 5 < 3").join(d.filter("doc_id % 5 >= 3").distinct(), "doc_id", "left_semi")
    return both.agg((F.count("*") == 0).alias("disjoint"))


@query("""WITH s AS (SELECT user_id % 60 AS candidate, json_extract_string(props, '$.k')::BIGINT AS seed FROM events), n AS (SELECT count(DISTINCT seed) AS n FROM s) SELECT candidate, count(DISTINCT seed) = any_value(n.n) AS complete FROM s, n GROUP BY 1""")
def seed_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each candidate ran with all seeds that any candidate ran with."""
    s = views.table(spark, sf_dir, "events").select((F.col("user_id") % 60).alias("candidate"), F.get_json_object("props", "$.k").cast("long").alias("seed")).distinct()
    n = s.agg(F.count_distinct("seed")).first()[0]
    return s.groupBy("candidate").agg((F.count("*") == n).alias("complete"))


# -- records of runs -------------------------------------------------------------------------------------------------


@query("SELECT user_id AS batch_id, count(*) AS n, count(DISTINCT event_type || (event_id % 2)::VARCHAR) AS accounts FROM events GROUP BY 1 HAVING count(DISTINCT event_type || (event_id % 2)::VARCHAR) > 1")
def inconsistent_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("batch_id"), "event_type", (F.col("event_id") % 2).alias("attempts"))
    return control.inconsistent_batches(e, ["event_type", "attempts"])


@query("SELECT event_id // 3 * (event_id % 2) AS item_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def repeated_item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select((F.expr("event_id div 3") * (F.col("event_id") % 2)).alias("item_id"))
    return control.repeated_ids(e, "item_id")


@query(views.sql("""SELECT request_id, round(overhead_ms * 0.5 + k, 6)::DOUBLE AS attributed_ms, round(greatest(0, overhead_ms - (overhead_ms * 0.5 + k)), 6)::DOUBLE AS unattributed_ms FROM v_requests""", "v_requests"))
def lane_overhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.requests(spark, sf_dir)
    lanes = r.select("request_id", F.explode(F.array(F.struct(F.lit("a").alias("lane"), (F.col("overhead_ms") * 0.5).alias("ms")), F.struct(F.lit("b").alias("lane"), F.col("k").cast("double").alias("ms")))).alias("x")).select("request_id", "x.*")
    return control.unattributed(lanes, r.select("request_id", "overhead_ms"), "request_id")


@query(views.sql("SELECT request_id, 400 - ttft_ms AS remaining_ms, least(k::DOUBLE * 4, greatest(0, 400 - ttft_ms)) AS child_ms FROM v_requests", "v_requests"))
def deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.requests(spark, sf_dir).select("request_id", control.child_deadline(F.lit(400.0), F.col("ttft_ms"), F.col("k") * 4.0).alias("d")).select("request_id", "d.*")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'malformed' WHEN 2 THEN 'no event' WHEN 3 THEN 'unknown event' ELSE 'empty' END AS problem, CASE WHEN event_id % 5 = 0 THEN event_id END AS seq FROM events""")
def frame_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames typed where they can be, with what is wrong where they can't; nothing is dropped."""
    i = F.col("event_id").cast("string")
    m = F.col("event_id") % 5
    raw = F.when(m == 0, F.concat(F.lit('{"event": "signal", "seq": '), i, F.lit("}"))).when(m == 1, '{"event": "signal", "seq"').when(m == 2, F.concat(F.lit('{"seq": "'), i, F.lit('"}'))).when(m == 3, '{"event": "chatter"}').otherwise(" ")
    f = views.table(spark, sf_dir, "events").select("event_id", control.frames(raw, "event string, seq string").alias("f"))
    return f.select("event_id", "f.problem", F.when(F.col("f.problem").isNull(), F.col("f.frame.seq").cast("long")).alias("seq"))


@query(views.sql("""SELECT tenant, count(*) AS written_or_dropped, count_if(k % 11 <> 0)::BIGINT AS written, count_if(k % 11 = 0)::BIGINT AS dropped FROM v_requests GROUP BY 1""", "v_requests"))
def writer_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a writer wrote and what it had to drop, by tenant: a bad row is counted, never fatal."""
    row = F.when(F.col("k") % 11 == 0, "{").otherwise(F.to_json(F.struct("request_id")))
    parsed = views.requests(spark, sf_dir).select("tenant", F.from_json(row, "request_id long, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    bad = F.col("r._broken").isNotNull()
    return parsed.groupBy("tenant").agg(F.count("*").alias("written_or_dropped"), F.count_if(~bad).alias("written"), F.count_if(bad).alias("dropped"))


@query(views.sql("""SELECT request_id, i AS seq, CASE i WHEN 0 THEN 'signal' WHEN 1 THEN 'signal' ELSE 'decision' END AS event, CASE WHEN i = 2 THEN CASE WHEN k % 4 = 0 THEN 'L0_pass' ELSE 'L2_repair' END ELSE ['ungrounded', 'contradicted', ''][(i + 1)::INT] END AS what,
    CASE WHEN i = 2 AND k % 4 <> 0 THEN 'would have passed' ELSE '' END AS counterfactual FROM v_requests, (VALUES (0), (1), (2)) AS t(i)""", "v_requests"))
def rendered_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request's frames: its signals before its decision, which says what would have been unless it passes."""
    action = F.when(F.col("k") % 4 == 0, "L0_pass").otherwise("L2_repair")
    frame = lambda event, what, other: F.struct(F.lit(event).alias("event"), what.alias("what"), other.alias("counterfactual"))
    signals = F.transform(F.array(F.lit("ungrounded"), F.lit("contradicted")), lambda n: frame("signal", n, F.lit("")))
    decision = frame("decision", action, F.when(action != "L0_pass", "would have passed").otherwise(""))
    out = views.requests(spark, sf_dir).select("request_id", F.posexplode(F.concat(signals, F.array(decision))).alias("seq", "f"))
    return out.select("request_id", "seq", "f.*")
