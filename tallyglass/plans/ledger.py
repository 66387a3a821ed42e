"""Registered queries over the ledger and decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass import policy, schemas, views
from tallyglass.functions import stats
from tallyglass.operators import decide, ledger

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_BOOK = "(VALUES " + ", ".join(f"('{m}', {i}, {p}::DOUBLE, {c}::DOUBLE)" for i, (m, p, c, _) in enumerate(policy.PRICES)) + ") AS b(book_model, book_order, pi, ci)"
_PRICED = f"""priced AS (SELECT r.*, x.book_model, coalesce(x.pi, 0.75) AS pi, coalesce(x.ci, 3.0) AS ci FROM v_requests r LEFT JOIN (
    SELECT model, arg_min(book_model, k) AS book_model, arg_min(pi, k) AS pi, arg_min(ci, k) AS ci FROM (
        SELECT m.model, b.*, CASE WHEN m.model = b.book_model THEN -1 ELSE b.book_order END AS k FROM (SELECT DISTINCT model FROM v_requests) m JOIN {_BOOK} ON starts_with(m.model, b.book_model)) GROUP BY model) x ON x.model = r.model)"""


@query(views.sql("SELECT request_id, round(sum(CASE WHEN component = 'upstream' THEN inr ELSE 0 END), 6) AS upstream_inr, round(sum(CASE WHEN component <> 'upstream' THEN inr ELSE 0 END), 6) AS verification_inr FROM v_spend GROUP BY 1", "v_requests", "v_spend"))
def spend_by_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.spend_by_request(views.spend(spark, sf_dir))


@query(views.sql("SELECT component, model, sum(tokens)::BIGINT AS tokens, round(sum(inr), 6) AS inr FROM v_spend GROUP BY 1, 2", "v_requests", "v_spend"))
def spend_by_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.spend_by_component(views.spend(spark, sf_dir))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.requests(spark, sf_dir)
    return r.select(F.element_at(F.array(F.lit("retry"), F.lit("escalation"), F.lit("regenerate")), (F.col("request_id") % 3 + 1).cast("int")).alias("kind"), (F.col("k") / 16.0).alias("inr_charged"), (F.col("request_id") - F.col("request_id") % 22).alias("parent"))


_EDGES = "v_edges AS (SELECT ['retry', 'escalation', 'regenerate'][(request_id % 3 + 1)::INT] AS kind, k::DOUBLE / 16.0::DOUBLE AS inr_charged, request_id - request_id % 22 AS parent FROM v_requests)"
_SHADOW = "v_shadow AS (SELECT request_id, ts, (k - 30)::DOUBLE / 8.0::DOUBLE AS saved, k < 50 AS sufficed FROM v_requests)"


@query(views.sql(f"WITH {_EDGES} SELECT kind, count(*) AS n, round(sum(inr_charged), 4) AS inr FROM v_edges GROUP BY 1", "v_requests"))
def rework_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.rework_by_kind(_edges(spark, sf_dir))


@query(views.sql(f"WITH {_EDGES} SELECT parent, count(*) AS n, round(sum(inr_charged), 4) AS inr FROM v_edges GROUP BY 1 ORDER BY inr DESC, parent LIMIT 5", "v_requests"))
def worst_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top five parents by rework: a limited report."""
    return _edges(spark, sf_dir).groupBy("parent").agg(F.count("*").alias("n"), F.round(F.sum("inr_charged"), 4).alias("inr")).orderBy(F.desc("inr"), "parent").limit(5)


def _shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.requests(spark, sf_dir)
    return r.select("request_id", "ts", ((F.col("k") - 30) / 8.0).alias("inr_saved_if_switched"), (F.col("k") < 50).alias("sufficed"))


@query(views.sql(f"""WITH {_EDGES}, {_SHADOW}, {_PRICED},
    r AS (SELECT count(*) AS requests, count_if(cache_hit)::BIGINT AS cache_hits, sum(prompt_tokens * 0.75::DOUBLE / 1000 + completion_tokens * 3.0::DOUBLE / 1000) AS baseline FROM priced),
    s AS (SELECT sum(CASE WHEN component = 'upstream' THEN inr END) AS up, sum(CASE WHEN component IN ('observer', 'verifier', 'judge', 'repair', 'reroute') THEN inr END) AS checks FROM v_spend),
    h AS (SELECT count(*) AS n, sum(greatest(saved, 0)) AS regret FROM v_shadow), w AS (SELECT count(*) AS n, sum(inr_charged) AS rework FROM v_edges)
    SELECT requests, cache_hits, round(up, 4) AS upstream_spend_inr, 'recorded' AS upstream_spend_basis, round(checks, 4) AS verification_spend_inr, round(checks / up, 6) AS verification_cost_ratio,
    round(baseline - up, 4) AS routing_savings_inr, round(regret, 4) AS regret_inr, h.n AS regret_samples, round(rework, 4) AS rework_inr, w.n AS rework_samples,
    round(baseline - up - rework - checks - regret, 4) AS net_value_inr FROM r, s, h, w""", "v_requests", "v_spend"))
def economics_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.economics(views.requests(spark, sf_dir), views.spend(spark, sf_dir), _shadow(spark, sf_dir), _edges(spark, sf_dir), policy.prices(spark))


@query()
def net_value_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.net_value_interval(ledger.contributions(views.requests(spark, sf_dir), views.spend(spark, sf_dir), policy.prices(spark)))


@query(views.sql("SELECT tenant, count(*) AS requests, count_if(degraded)::BIGINT AS degraded, round(avg(overhead_ms), 4) AS overhead_mean_ms, quantile_disc(overhead_ms, 0.95) AS overhead_p95_ms FROM v_requests GROUP BY 1", "v_requests"))
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ledger_summary(views.requests(spark, sf_dir))


_LATENCY = "SELECT {keys}, {shares} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {v}, request_id) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM v_requests WHERE {v} > 0) GROUP BY {keys}"


def _ranks(keys: str, v: str, **shares: float) -> str:
    parts = ", ".join(f"max(CASE WHEN i = round_even({s}::DOUBLE * (n - 1), 0) THEN {v} END) AS {name}" for name, s in shares.items())
    return views.sql(_LATENCY.format(keys=keys, v=v, shares=parts), "v_requests")


@query(_ranks("domain", "overhead_ms", p50=0.5, p95=0.95, p99=0.99))
def latency_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ranked_percentiles(views.requests(spark, sf_dir).filter("overhead_ms > 0"), ["domain"], "overhead_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(_ranks("event_type", "ttft_ms", p50=0.5, p95=0.95))
def latency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time to first token by kind of request, measured ones only."""
    return ledger.ranked_percentiles(views.requests(spark, sf_dir).filter("ttft_ms > 0"), ["event_type"], "ttft_ms", {"p50": 0.5, "p95": 0.95})


@query(views.sql("""SELECT tenant, request_id, v[(round_even(0.95::DOUBLE * (len(v) - 1), 0) + 1)::INT] AS p95_ms FROM (
    SELECT tenant, request_id, list_sort(list(overhead_ms) OVER (PARTITION BY tenant ORDER BY ts, request_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)) AS v FROM v_requests)""", "v_requests"))
def rolling_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.rolling_p95(views.requests(spark, sf_dir))


@query(views.sql(f"WITH {_PRICED} SELECT model, coalesce(book_model, '-') AS book_model, count(*) AS n, round(sum(prompt_tokens * pi / 1000 + completion_tokens * ci / 1000), 4) AS inr FROM priced GROUP BY 1, 2", "v_requests"))
def price_lookup_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ledger.priced(views.requests(spark, sf_dir), policy.prices(spark))
    return p.groupBy("model", F.coalesce("book_model", F.lit("-")).alias("book_model")).agg(F.count("*").alias("n"), F.round(F.sum(ledger.cost(F.col("prompt_inr"), F.col("completion_inr"))), 4).alias("inr"))


@query(views.sql(f"WITH {_PRICED} SELECT model, count(*) AS misses FROM priced WHERE book_model IS NULL GROUP BY 1", "v_requests"))
def unpriced_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.unpriced(views.requests(spark, sf_dir), policy.prices(spark))


@query(views.sql(f"""WITH {_SHADOW}, x AS (SELECT CASE WHEN sufficed THEN greatest(saved, 0) ELSE 0 END AS r, sufficed FROM v_shadow)
    SELECT count(*) AS n, round(avg(r), 6) AS mean_inr, round(avg(r) * 10000, 4) AS scaled_inr, round(count_if(sufficed)::DOUBLE / count(*), 6) AS over_routing_rate, count(*) >= 30 AS reliable FROM x""", "v_requests"))
def regret_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    regret = F.when(F.col("sufficed"), F.greatest(F.lit(0.0), F.col("inr_saved_if_switched"))).otherwise(0.0)
    return ledger.regret_estimate(_shadow(spark, sf_dir).withColumn("regret_inr", regret), 10000)


_PAIRS = """v_pairs AS (SELECT a.request_id AS pair_id, ['name', 'city', 'language'][(a.request_id % 3 + 1)::INT] AS attribute, a.event_type AS base_value, b.event_type AS twin_value,
    CASE WHEN a.k % 3 = 0 THEN NULL WHEN a.k % 3 = 1 THEN '0' ELSE (a.k - b.k)::VARCHAR END AS delta, a.ts FROM v_requests a JOIN v_requests b ON b.request_id = a.request_id + 1 WHERE a.request_id % 2 = 0)"""
_DISPARATE = "coalesce(abs(try_cast(delta AS DOUBLE)) > 0, base_value <> twin_value)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.requests(spark, sf_dir)
    a, b = r.filter("request_id % 2 = 0").alias("a"), r.filter("request_id % 2 = 1").alias("b")
    delta = F.when(F.col("a.k") % 3 == 0, None).when(F.col("a.k") % 3 == 1, "0").otherwise((F.col("a.k") - F.col("b.k")).cast("string"))
    return a.join(b, F.col("b.request_id") == F.col("a.request_id") + 1).select(
        F.col("a.request_id").alias("pair_id"), views.pick(("name", "city", "language"), F.col("a.request_id") % 3).alias("attribute"), F.col("a.event_type").alias("base_value"), F.col("b.event_type").alias("twin_value"), delta.alias("delta"), F.col("a.ts").alias("ts"),
    )


@query(views.sql(f"WITH {_PAIRS} SELECT attribute, count(*) AS n, count_if({_DISPARATE})::BIGINT AS disparate, round(count_if({_DISPARATE})::DOUBLE / count(*), 4) AS rate FROM v_pairs GROUP BY 1", "v_requests"))
def fairness_by_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.fairness_by_axis(_pairs(spark, sf_dir))


_HOLDS = """v_holds AS (SELECT request_id AS hold_id, CASE WHEN k % 2 = 0 THEN 'response' ELSE 'tool' END AS kind, request_id::DOUBLE AS created_ts,
    CASE WHEN k % 3 = 0 THEN NULL ELSE request_id::DOUBLE + k * 10 END AS sla_deadline_ts, CASE WHEN k % 5 = 0 THEN 'approved' ELSE 'pending' END AS state FROM v_requests)"""


@query(views.sql(f"""WITH {_HOLDS} SELECT hold_id, kind, created_ts, coalesce(sla_deadline_ts, CASE WHEN kind = 'response' THEN created_ts END) AS deadline_ts,
    coalesce(3000 > coalesce(sla_deadline_ts, CASE WHEN kind = 'response' THEN created_ts END), false) AS expired FROM v_holds WHERE state = 'pending'""", "v_requests"))
def pending_holds_sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, i = F.col("k"), F.col("request_id").cast("double")
    holds = views.requests(spark, sf_dir).select(
        F.col("request_id").alias("hold_id"), F.when(k % 2 == 0, "response").otherwise("tool").alias("kind"), i.alias("created_ts"), F.when(k % 3 != 0, i + k * 10).alias("sla_deadline_ts"), F.when(k % 5 == 0, "approved").otherwise("pending").alias("state"),
    )
    return ledger.pending_holds(holds, 3000.0)


@query(views.sql("""WITH x AS (SELECT request_id // 4 AS hold_id, request_id % 4 AS seq, request_id::DOUBLE AS ts, ['approve', 'reject', 'expire', 'note'][(k % 4 + 1)::INT] AS event, k % 3 <> 0 AS token_ok, (request_id // 4) * 4 + 2 AS deadline FROM v_requests),
    y AS (SELECT hold_id, arg_min(event, seq) AS e, min(ts) AS resolved_ts FROM x WHERE event IN ('reject', 'expire') OR (event = 'approve' AND token_ok AND ts <= deadline) GROUP BY 1)
    SELECT h.hold_id, CASE e WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'expire' THEN 'expired' ELSE 'pending' END AS state, resolved_ts FROM (SELECT DISTINCT hold_id FROM x) h LEFT JOIN y ON y.hold_id = h.hold_id""", "v_requests"))
def hold_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = F.col("request_id"), F.col("k")
    hold = F.expr("request_id div 4")
    events = views.requests(spark, sf_dir).select(hold.alias("hold_id"), (i % 4).alias("seq"), i.cast("double").alias("ts"), views.pick(("approve", "reject", "expire", "note"), k % 4).alias("event"), (k % 3 != 0).alias("token_ok"), (hold * 4 + 2).alias("deadline_ts"))
    return ledger.hold_states(events)


@query(views.sql("SELECT request_id, max(ts) AS ts, arg_max(state, v) AS state FROM (SELECT request_id % 500 AS request_id, ts, event_type AS state, request_id AS v FROM v_requests) GROUP BY 1", "v_requests"))
def upsert_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.requests(spark, sf_dir).select((F.col("request_id") % 500).alias("request_id"), "ts", F.col("event_type").alias("state"), F.col("request_id").alias("v"))
    return ledger.latest(r, ["request_id"], "v").select("request_id", "ts", "state")


@query(views.sql("SELECT r.tenant, r.domain, r.event_type, count(*) AS n, sum(tokens)::BIGINT AS tokens, grouping(r.tenant) * 4 + grouping(r.domain) * 2 + grouping(r.event_type) AS level FROM v_requests r JOIN v_spend s ON s.request_id = r.request_id GROUP BY ROLLUP (r.tenant, r.domain, r.event_type)", "v_requests", "v_spend"))
def spend_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = views.requests(spark, sf_dir).select("request_id", "tenant", "domain", "event_type").join(views.spend(spark, sf_dir).select("request_id", "tokens"), "request_id")
    return joined.rollup("tenant", "domain", "event_type").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.grouping_id().alias("level"))


# -- decisions -------------------------------------------------------------------------------------------------------

_ROLES = ("customer", "agent", "underwriter", "admin", "guest")
_STAKES = f"""v_stakes AS (SELECT r.*, round(d.impact * CASE WHEN amount_inr >= 100000 THEN 3.0 WHEN amount_inr >= 10000 THEN 1.5 ELSE 1.0 END * CASE k % 5 WHEN 1 THEN 1.2 WHEN 2 THEN 1.5 WHEN 3 THEN 2.0 ELSE 1.0 END
    * CASE WHEN request_id % 6 >= 3 THEN 1.25 ELSE 1.0 END, 2)::DOUBLE AS impact_inr, ['reversible', 'costly', 'irreversible'][greatest(d.rev, CASE WHEN k % 7 < 3 THEN k % 7 END) + 1] AS reversibility,
    (CASE k % 4 WHEN 0 THEN CASE WHEN k % 8 >= 2 THEN 0.9 ELSE 0.75 END WHEN 1 THEN 0.55 ELSE 0.25 END)::DOUBLE AS confidence
    FROM v_requests r JOIN (VALUES {", ".join(f"('{d}', {i}, {schemas.REVERSIBILITY.index(v)})" for d, (i, v) in policy.POLICY["domains"].items())}) AS d(domain, impact, rev) ON d.domain = r.domain)"""


def _stakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    r = views.requests(spark, sf_dir).withColumns({
        "user_role": views.pick(_ROLES, k % 5), "depth": F.col("request_id") % 6, "tool_reversibility": F.when(k % 7 < 3, views.pick(schemas.REVERSIBILITY, k % 7)),
        "domain_source": F.when(k % 4 == 0, "retrieved").when(k % 4 == 1, "intent").otherwise("default"), "n_retrieved": k % 8,
    })
    return decide.stakes(r, policy.domains(spark))


@query(views.sql(f"WITH {_STAKES} SELECT request_id, impact_inr, reversibility, confidence FROM v_stakes", "v_requests"))
def stakes_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stakes(spark, sf_dir).select("request_id", "impact_inr", "reversibility", "confidence")


@query(views.sql("SELECT CASE WHEN amount_inr >= 100000 THEN 3.0 WHEN amount_inr >= 10000 THEN 1.5 ELSE 1.0 END::DOUBLE AS multiplier, count(*) AS n FROM v_requests GROUP BY 1", "v_requests"))
def monetary_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.requests(spark, sf_dir).groupBy(decide.band_multiplier(F.col("amount_inr")).alias("multiplier")).agg(F.count("*").alias("n"))


@query(views.sql(f"WITH {_STAKES} SELECT request_id, CASE WHEN degraded OR impact_inr >= 1000 OR p_overconfident >= 0.65 THEN 'strong' ELSE 'cheap' END AS tier, CASE WHEN impact_inr >= 1000 THEN 'buffered' ELSE 'passthrough' END AS gate_mode FROM v_stakes", "v_requests"))
def route_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stakes(spark, sf_dir).select("request_id", decide.tier(F.col("impact_inr"), F.col("p_overconfident"), F.col("degraded")).alias("tier"), decide.gate_mode(F.col("impact_inr")).alias("gate_mode"))


@query(views.sql("SELECT request_id, round(1 - (1 - p_ungrounded) * (1 - p_contradicted) * (1 - p_overconfident), 9) AS p_any FROM v_requests", "v_requests"))
def p_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    probs = F.array("p_ungrounded", "p_contradicted", "p_overconfident")
    return views.requests(spark, sf_dir).select("request_id", F.round(stats.p_any(probs), 9).alias("p_any"))


_ACTIONS = ", ".join(
    f"('{a}', {i}, {policy.POLICY['nuisance_inr'][a]}::DOUBLE, {policy.POLICY['compute_tokens'][a]}, {policy.POLICY['latency_ms'][a]}, {220 if i > 3 else 0}, {', '.join(str(policy.POLICY['efficacy'][a].get(d, 0.0)) + '::DOUBLE' for d in schemas.DEFECTS[:3])})"
    for i, a in enumerate(schemas.ACTIONS)
)


def _priced_sql(scale: str = "1.0::DOUBLE", band: str = "0.015::DOUBLE", nuisance: str = "20.0::DOUBLE", source: str = "v_stakes s", more: str = "") -> str:
    p = lambda d: f"greatest(0, p_{d} - {band})"
    rev = "CASE reversibility WHEN 'reversible' THEN 1.0 WHEN 'costly' THEN 2.5 ELSE 8.0 END::DOUBLE"
    harm = " + ".join(f"{p(d)} * impact_inr * {scale} * {m}::DOUBLE * {rev} * (1 - a.e{i})" for i, (d, m) in enumerate((("ungrounded", 1.0), ("contradicted", 1.4), ("overconfident", 1.2))))
    return f"""v_priced AS (SELECT request_id, {more} action, ladder, {harm} + (1 - (1 - (1 - {p("ungrounded")}) * (1 - {p("contradicted")}) * (1 - {p("overconfident")}))) * nuis * {nuisance}
        + tok * 0.6::DOUBLE / 1000 + rev + 0.4::DOUBLE * lat / 1000 AS total, NOT (request_id % 4 = 0 AND action IN ('L2_repair', 'L3_reroute', 'L5_block')) AND (p_ungrounded < 0.9 OR action <> 'L0_pass') AS available
        FROM {source}, (VALUES {_ACTIONS}) AS a(action, ladder, nuis, tok, lat, rev, e0, e1, e2))"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    probs = F.create_map(*[x for d in schemas.DEFECTS[:3] for x in (F.lit(d), F.col(f"p_{d}"))])
    return _stakes(spark, sf_dir).select("request_id", "impact_inr", "reversibility", probs.alias("probs"), (F.col("request_id") % 4 == 0).alias("emitted"), (F.col("p_ungrounded") < 0.9).alias("feasible_pass"))


@query(views.sql(f"WITH {_STAKES}, {_priced_sql()} SELECT request_id, action, round(total, 6) AS total, available FROM v_priced", "v_requests"))
def price_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.priced_actions(_items(spark, sf_dir), "request_id").select("request_id", "action", F.round("total", 6).alias("total"), "available")


_CHOSEN = "x AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY total, ladder) AS n FROM v_priced WHERE available), v_chosen AS (SELECT a.request_id, a.action, a.total AS chosen_loss, b.action AS runner_up, b.total - a.total AS margin FROM x a JOIN x b ON b.request_id = a.request_id AND b.n = 2 WHERE a.n = 1)"


@query(views.sql(f"WITH {_STAKES}, {_priced_sql()}, {_CHOSEN} SELECT request_id, action, round(chosen_loss, 6) AS chosen_loss, runner_up, round(margin, 6) AS margin FROM v_chosen", "v_requests"))
def choose_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = decide.chosen(decide.options(_items(spark, sf_dir)), "request_id")
    return c.select("request_id", "action", F.round("chosen_loss", 6).alias("chosen_loss"), "runner_up", F.round("margin", 6).alias("margin"))


@query(views.sql(f"WITH {_STAKES}, {_priced_sql()}, {_CHOSEN} SELECT action, count(*) AS n, round(avg(margin), 2) AS mean_margin FROM v_chosen GROUP BY 1", "v_requests"))
def action_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = decide.chosen(decide.options(_items(spark, sf_dir)), "request_id")
    return c.groupBy("action").agg(F.count("*").alias("n"), F.round(F.avg("margin"), 2).alias("mean_margin"))


@query(views.sql(f"WITH {_STAKES}, {_priced_sql()} SELECT action, count(*) AS n FROM v_priced WHERE NOT available GROUP BY 1", "v_requests"))
def unavailable_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.priced_actions(_items(spark, sf_dir), "request_id").filter("not available").groupBy("action").agg(F.count("*").alias("n"))


@query(views.sql(f"""WITH {_STAKES}, {_priced_sql()}, {_CHOSEN}, h AS (SELECT request_id, CASE WHEN k % 10 = 0 THEN 'canary' WHEN k % 5 = 0 THEN 'injection' END AS rule, CASE WHEN k % 10 = 0 THEN 'L5_block' WHEN k % 5 = 0 THEN 'L4_hold' END AS act FROM v_requests)
    SELECT c.request_id, coalesce(h.act, c.action) AS action, round(coalesce(p.total, c.chosen_loss), 6) AS chosen_loss, h.rule AS hard_rule FROM v_chosen c JOIN h ON h.request_id = c.request_id LEFT JOIN v_priced p ON p.request_id = c.request_id AND p.action = h.act""", "v_requests"))
def hard_rule_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.requests(spark, sf_dir).select("request_id", "k")
    rules = r.filter("k % 5 = 0").select("request_id", F.lit("injection").alias("rule"), F.lit("L4_hold").alias("rule_action")).unionByName(r.filter("k % 10 = 0").select("request_id", F.lit("canary").alias("rule"), F.lit("L5_block").alias("rule_action")))
    c = decide.chosen(decide.options(_items(spark, sf_dir)), "request_id", rules)
    return c.select("request_id", "action", F.round("chosen_loss", 6).alias("chosen_loss"), "hard_rule")


@query(views.sql("SELECT request_id, NOT (1 - (1 - p_ungrounded) * (1 - p_contradicted) * (1 - p_overconfident) >= 0.5) AS pass_feasible FROM v_requests", "v_requests"))
def conformal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    probs = F.array("p_ungrounded", "p_contradicted", "p_overconfident")
    return views.requests(spark, sf_dir).select("request_id", (~(stats.p_any(probs) >= 0.5)).alias("pass_feasible"))


def _break_even_sql() -> str:
    """Where passing meets each other action's line, and the least of these."""
    p, rev = policy.POLICY, "CASE rev WHEN 'reversible' THEN 1.0 WHEN 'costly' THEN 2.5 ELSE 8.0 END::DOUBLE"
    roots = []
    for a in schemas.ACTIONS[1:]:
        fixed = p["compute_tokens"][a] * 0.6 / 1000 + (220 if a in ("L4_hold", "L5_block") else 0) + 0.4 * p["latency_ms"][a] / 1000
        n, e = p["nuisance_inr"][a], p["efficacy"][a]["ungrounded"]
        roots.append(f"({fixed + n!r}::DOUBLE) / (impact * {rev} * {e}::DOUBLE + {n}::DOUBLE)")
    values = ", ".join(f"('{d}', {i}::DOUBLE, '{r}')" for d, (i, r) in p["domains"].items())
    return f"SELECT domain, round(least(1.0, {', '.join(roots)}), 9) AS floor FROM (VALUES {values}) AS t(domain, impact, rev)"


@query(_break_even_sql())
def break_even_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = policy.domains(spark)
    return d.select("domain", F.round(decide.break_even(F.col("base_impact"), F.col("base_reversibility")), 9).alias("floor"))


@query(views.sql("""WITH c AS (SELECT request_id, ['lookup_balance', 'raise_ticket', 'send_email', 'transfer_funds', 'unheard_of'][(request_id % 5 + 1)::INT] AS tool, ['system', 'user', 'retrieved_verified', 'retrieved_untrusted', 'tool_external'][(k % 5 + 1)::INT] AS taint, amount_inr FROM v_requests),
    d AS (SELECT *, CASE tool WHEN 'lookup_balance' THEN 'reversible' WHEN 'send_email' THEN 'irreversible' WHEN 'transfer_funds' THEN 'irreversible' ELSE 'costly' END AS reversibility, tool <> 'unheard_of' AS declared, tool = 'transfer_funds' AND amount_inr > 0 AS capped, taint IN ('retrieved_untrusted', 'tool_external') AS tainted FROM c)
    SELECT request_id, tool, reversibility, declared, CASE WHEN capped THEN 'hold' WHEN reversibility = 'reversible' THEN 'allow' WHEN tainted THEN 'hold' ELSE 'allow' END AS verdict,
    CASE WHEN capped THEN 'over_cap' WHEN reversibility = 'reversible' THEN 'reversible' WHEN tainted THEN 'tainted' ELSE 'clean' END AS reason FROM d""", "v_requests"))
def tool_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = views.requests(spark, sf_dir).select("request_id", views.pick(views.TOOLS, F.col("request_id") % 5).alias("tool"), views.pick(schemas.PROVENANCE, F.col("k") % 5).alias("taint"), "amount_inr")
    return decide.tool_decisions(calls, policy.tools(spark)).drop("taint", "amount_inr")


@query(views.sql("SELECT session_id, ['system', 'user', 'retrieved_verified', 'retrieved_untrusted', 'tool_external'][(max(k % 5 * (k % 7 // 6)) + 1)::INT] AS provenance FROM v_requests GROUP BY 1", "v_requests"))
def provenance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return decide.most_tainted(views.requests(spark, sf_dir).select("session_id", views.pick(schemas.PROVENANCE, k % 5 * F.floor(k % 7 / 6)).alias("provenance")), "session_id")


_GRID = "v_grid AS (SELECT (i * 36 + j * 6 + n)::INT AS candidate, [0.25, 0.5, 0.75, 1.0, 1.25, 1.5][i + 1]::DOUBLE AS scale, [0.0, 0.005, 0.01, 0.015, 0.02, 0.03][j + 1]::DOUBLE AS band, [1.0, 2.0, 5.0, 10.0, 15.0, 20.0][n + 1]::DOUBLE AS nuisance FROM range(6) AS a(i), range(6) AS b(j), range(6) AS c(n))"


def _grid_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each candidate adjustment: how often clean and defective domains are intervened on."""
    grid = decide.candidate_grid(spark)
    d = policy.domains(spark).withColumn("p", F.explode(F.array(*[F.lit(x) for x in (0.005, 0.02, 0.05, 0.2, 0.6)])))
    acts, eff = policy.actions(spark), {a: row.get("ungrounded", 0.0) for a, row in policy.POLICY["efficacy"].items()}
    rows = d.crossJoin(F.broadcast(grid)).crossJoin(F.broadcast(acts))  # 7 domains, 5 levels, 216 candidates, 6 actions: fixed tables
    live = F.greatest(F.lit(0.0), F.col("p") - F.col("deadband"))
    reverse = F.element_at(F.create_map(*[F.lit(x) for kv in policy.POLICY["reversibility"].items() for x in kv]), F.col("base_reversibility"))
    effect = F.element_at(F.create_map(*[F.lit(x) for kv in eff.items() for x in kv]), F.col("action"))
    total = live * F.col("base_impact") * F.col("impact_scale") * reverse * (1 - effect) + (1 - live) * F.col("nuisance_inr") * F.col("nuisance_multiplier") + F.col("compute_tokens") * 0.6 / 1000 + F.col("review_inr") + 0.4 * F.col("latency_ms") / 1000
    best = rows.groupBy("candidate", "domain", "p").agg(F.min_by("action", F.struct(F.round(total, 6), F.col("ladder"))).alias("action"))
    acted = F.col("action") != "L0_pass"
    return best.groupBy("candidate").agg(F.count_if(acted & (F.col("p") < 0.03)).alias("false_interventions"), F.count_if(~acted & (F.col("p") > 0.03)).alias("escapes"), F.count_if(F.col("action").isin("L4_hold", "L5_block")).alias("disruptive"))


_GRID_SQL = f"""{_GRID}, g AS (SELECT candidate, d.domain, p, action, ladder, round(greatest(0, p - band) * impact * scale * CASE rev WHEN 'reversible' THEN 1.0 WHEN 'costly' THEN 2.5 ELSE 8.0 END::DOUBLE * (1 - e0)
    + (1 - greatest(0, p - band)) * nuis * nuisance + tok * 0.6::DOUBLE / 1000 + rv + 0.4::DOUBLE * lat / 1000, 6) AS total
    FROM v_grid, (VALUES {", ".join(f"('{d}', {i}::DOUBLE, '{r}')" for d, (i, r) in policy.POLICY["domains"].items())}) AS d(domain, impact, rev), (VALUES (0.005::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE), (0.2::DOUBLE), (0.6::DOUBLE)) AS l(p), (VALUES {_ACTIONS}) AS a(action, ladder, nuis, tok, lat, rv, e0, e1, e2)),
    b AS (SELECT candidate, domain, p, action FROM (SELECT *, row_number() OVER (PARTITION BY candidate, domain, p ORDER BY total, ladder) AS n FROM g) WHERE n = 1),
    m AS (SELECT candidate, count_if(action <> 'L0_pass' AND p < 0.03)::BIGINT AS false_interventions, count_if(action = 'L0_pass' AND p > 0.03)::BIGINT AS escapes, count_if(action IN ('L4_hold', 'L5_block'))::BIGINT AS disruptive FROM b GROUP BY 1)"""


@query(f"WITH {_GRID_SQL} SELECT * FROM m")
def candidate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid_losses(spark, sf_dir)


@query(f"WITH {_GRID_SQL} SELECT * FROM m x WHERE NOT EXISTS (SELECT 1 FROM m y WHERE y.false_interventions <= x.false_interventions AND y.escapes <= x.escapes AND y.disruptive <= x.disruptive AND (y.false_interventions < x.false_interventions OR y.escapes < x.escapes OR y.disruptive < x.disruptive))")
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.pareto(_grid_losses(spark, sf_dir), ["false_interventions", "escapes", "disruptive"])
