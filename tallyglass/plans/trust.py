"""Registered queries on statistics, sequences and evaluation, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass import schemas, views
from tallyglass.functions import stats
from tallyglass.operators import evaluate, measure, sequences

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_BIN = "greatest(0, ceil(round(p * 10, 9)) - 1)::INT"


@query(views.sql(f"SELECT lang, round(sum(n * abs(mp - my)) / sum(n), 9) AS ece, sum(n)::BIGINT AS n FROM (SELECT lang, {_BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM v_scored GROUP BY 1, 2) GROUP BY 1", "v_scored"))
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.calibration_error(views.scored(spark, sf_dir), ["lang"]).withColumn("ece", F.round("ece", 9))


@query(views.sql(f"SELECT b::INT AS bin, coalesce(n, 0) AS n, round(coalesce(mp, 0), 9) AS mean_p, round(coalesce(my, 0), 9) AS rate FROM range(10) AS r(b) LEFT JOIN (SELECT {_BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM v_scored GROUP BY 1) s ON s.bin = b", "v_scored"))
def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.reliability(views.scored(spark, sf_dir)).select("bin", "n", F.round("mean_p", 9).alias("mean_p"), F.round("rate", 9).alias("rate"))


_AUROC = """v_area AS (SELECT lang, count(*) AS n, sum(y)::BIGINT AS positives, round(CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))::DOUBLE END, 9) AS auroc, round(avg((p - y) ** 2), 9) AS brier
    FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0::DOUBLE AS r FROM v_scored) GROUP BY 1)"""


@query(views.sql(f"WITH {_AUROC} SELECT * FROM v_area", "v_scored"))
def brier_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = measure.auroc(views.scored(spark, sf_dir), ["lang"])
    return a.select("lang", "n", "positives", F.round("auroc", 9).alias("auroc"), F.round("brier", 9).alias("brier"))


@query(views.sql(f"""WITH {_AUROC}, q AS (SELECT lang, auroc AS a, positives AS m, n - positives AS k, auroc / (2 - auroc) AS q1, 2 * auroc * auroc / (1 + auroc) AS q2 FROM v_area)
    SELECT lang, round(CASE WHEN m > 0 AND k > 0 THEN sqrt(greatest(0, (a * (1 - a) + (m - 1) * (q1 - a * a) + (k - 1) * (q2 - a * a)) / (m * k))) END, 6) AS se FROM q""", "v_scored"))
def hanley_mcneil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.auroc(views.scored(spark, sf_dir), ["lang"]).select("lang", F.round("auroc_se", 6).alias("se"))


@query(views.sql("SELECT source, count(*) AS n, sum(y)::BIGINT AS k, round(greatest(0, (k / n + 3.8416::DOUBLE / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)), 9) AS low, round(least(1, (k / n + 3.8416::DOUBLE / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)), 9) AS high FROM v_scored GROUP BY 1".replace("k / n", "sum(y)::DOUBLE / count(*)").replace("* n)", "* count(*))").replace("* n * n)", "* count(*) * count(*))").replace("/ n", "/ count(*)").replace("* n *", "* count(*) *"), "v_scored"))
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scored(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    low, high = stats.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return s.select("source", "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def _hb(k: str, n: str) -> str:
    """The smaller of both p-values for k of n at 0.05, in SQL with lgamma."""
    rate = f"({k}::DOUBLE / {n})"
    cdf = f"list_sum(list_transform(range(0, ({k} + 1)::BIGINT), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln(0.05::DOUBLE) + ({n} - i) * ln(0.95::DOUBLE))))"
    return f"least(CASE WHEN {rate} >= 0.05 THEN 1.0 ELSE exp(-2 * {n} * (0.05::DOUBLE - {rate}) ** 2) END, 1.0, {math.e}::DOUBLE * least(1.0, {cdf}))"


@query(f"SELECT n::BIGINT AS n, k::BIGINT AS k, round({_hb('k', 'n')}, 9) AS p_value FROM (VALUES (10), (60), (100), (400), (840)) AS a(n), (VALUES (0), (1), (3), (10)) AS b(k)")
def hoeffding_bentkus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(n, k) for n in (10, 60, 100, 400, 840) for k in (0, 1, 3, 10)], "n long, k long")
    return rows.select("n", "k", F.round(stats.hoeffding_bentkus(F.col("k") / F.col("n"), F.col("n"), 0.05), 9).alias("p_value"))


@query(views.sql(f"""WITH g AS (SELECT c, round(c * 0.005::DOUBLE, 6) AS threshold FROM range(201) AS r(c)), t AS (SELECT count(*) AS n, sum(y)::BIGINT AS d FROM v_scored),
    s AS (SELECT c, threshold, (SELECT coalesce(sum(y), 0)::BIGINT FROM v_scored WHERE p < threshold - 1e-9) AS k, (SELECT count(*) FROM v_scored WHERE p < threshold - 1e-9) AS passed FROM g),
    x AS (SELECT c, threshold, k::DOUBLE / d AS e, 1 - passed::DOUBLE / n AS i, {_hb('k', 'd')} AS v FROM s, t)
    SELECT threshold, round(e, 9) AS escape_rate, round(i, 9) AS intervention_rate, round(v, 9) AS p_value, bool_and(v <= 0.1) OVER (ORDER BY c) AS certified FROM x""", "v_scored"))
def conformal_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = measure.threshold_sweep(views.scored(spark, sf_dir), 0.05, 0.1)
    return s.select(F.round("threshold", 6).alias("threshold"), F.round("escape_rate", 9).alias("escape_rate"), F.round("intervention_rate", 9).alias("intervention_rate"), F.round("p_value", 9).alias("p_value"), "certified")


@query(views.sql("""WITH x AS (SELECT tenant, request_id, (event_type = 'error')::INT::DOUBLE AS x FROM v_requests), p AS (SELECT *, count(*) OVER w AS n, avg(x) OVER w AS m, avg(x * x) OVER w AS q FROM x WINDOW w AS (PARTITION BY tenant ORDER BY request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    b AS (SELECT *, CASE WHEN n < 10 OR m - 0.05::DOUBLE <= 0 THEN 0 ELSE least((m - 0.05::DOUBLE) / (greatest(1e-12, q - m ** 2) + (m - 0.05::DOUBLE) ** 2), 10.0) END AS bet FROM p),
    e AS (SELECT *, sum(ln(1 + bet * (x - 0.05::DOUBLE))) OVER (PARTITION BY tenant ORDER BY request_id) AS l FROM b)
    SELECT tenant, request_id, round(bet, 9) AS bet, round(l, 6) AS log_e, greatest(0, max(l) OVER (PARTITION BY tenant ORDER BY request_id)) >= ln(20::DOUBLE) AS alerted FROM e""", "v_requests"))
def evalue_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.requests(spark, sf_dir).select("tenant", "request_id", (F.col("event_type") == "error").cast("double").alias("x"))
    e = measure.evalues(r, ["tenant"], ["request_id"])
    return e.select("tenant", "request_id", F.round("bet", 9).alias("bet"), F.round("log_e", 6).alias("log_e"), "alerted")


_JUDGED = """v_judged AS (SELECT event_id AS item_id, ['clean', 'clean', 'ungrounded', 'contradicted'][(event_id % 4 + 1)::INT] AS gold, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'clean' WHEN event_id % 11 = 0 THEN 'ungrounded' ELSE ['clean', 'clean', 'ungrounded', 'contradicted'][(event_id % 4 + 1)::INT] END AS judged,
    event_type AS failure_mode, user_id % 3 AS challenge_level, user_id % 7 AS domain FROM events)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    gold = views.pick(("clean", "clean", "ungrounded", "contradicted"), i % 4)
    judged = F.when(i % 13 == 0, None).when(i % 7 == 0, "clean").when(i % 11 == 0, "ungrounded").otherwise(gold)
    return views.table(spark, sf_dir, "events").select(i.alias("item_id"), gold.alias("gold"), judged.alias("judged"), F.col("event_type").alias("failure_mode"), (F.col("user_id") % 3).alias("challenge_level"), (F.col("user_id") % 7).alias("domain"))


_RATES = "count(*) AS n, count_if(gold = judged)::BIGINT AS strict, count_if((gold <> 'clean') = (judged <> 'clean'))::BIGINT AS binary, count_if(gold = 'clean')::BIGINT AS clean, count_if(gold = 'clean' AND judged <> 'clean')::BIGINT AS false_interventions, count_if(gold <> 'clean')::BIGINT AS defective, count_if(gold <> 'clean' AND judged = 'clean')::BIGINT AS escapes"


@query(f"WITH {_JUDGED} SELECT failure_mode, challenge_level, domain, {_RATES} FROM v_judged WHERE judged IS NOT NULL GROUP BY GROUPING SETS ((failure_mode), (challenge_level), (domain), ())")
def agreement_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.agreement(_judged(spark, sf_dir), [["failure_mode"], ["challenge_level"], ["domain"], []])


@query(f"WITH {_JUDGED} SELECT gold, count_if(judged = 'clean')::BIGINT AS clean, count_if(judged = 'ungrounded')::BIGINT AS ungrounded, count_if(judged = 'contradicted')::BIGINT AS contradicted FROM v_judged WHERE judged IS NOT NULL GROUP BY 1")
def agreement_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.confusion(_judged(spark, sf_dir))


@query(f"WITH {_JUDGED}, x AS (SELECT gold <> 'clean' AS f, judged <> 'clean' AS j FROM v_judged) SELECT count(*) AS n, count_if(j IS NULL)::BIGINT AS unclear, round(count_if(j = f)::DOUBLE / count(j), 6) AS agreement, count_if(j AND NOT f)::BIGINT AS missed, count_if(NOT j AND f)::BIGINT AS over_flagged FROM x")
def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(spark, sf_dir).select((F.col("gold") != "clean").alias("flagged"), (F.col("judged") != "clean").alias("judged_bad"))
    return measure.judge_agreement(j)


@query(views.sql("""WITH a AS (SELECT domain, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM v_requests WHERE event_type <> 'error' GROUP BY 1), b AS (SELECT domain, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM v_requests WHERE event_type = 'error' GROUP BY 1)
    SELECT coalesce(a.domain, b.domain) AS domain, round(coalesce(b.s, 0) - coalesce(a.s, 0), 4) AS shift FROM a FULL JOIN b ON a.domain = b.domain""", "v_requests"))
def input_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.requests(spark, sf_dir)
    return measure.input_shift(r.filter("event_type <> 'error'"), r.filter("event_type = 'error'"), "domain")


@query(views.sql(f"""WITH e AS (SELECT source, sum(n * abs(mp - my)) / sum(n) AS ece, sum(n)::BIGINT AS n FROM (SELECT source, {_BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM v_scored GROUP BY 1, 2) GROUP BY 1)
    SELECT source, CASE WHEN n < 50 THEN 'watch' WHEN ece >= 0.10 THEN 'untrusted' WHEN ece > 0.06 THEN 'watch' ELSE 'trusted' END AS trust, CASE WHEN n < 50 THEN 'too_few_anchors' WHEN ece >= 0.10 THEN 'calibration' WHEN ece > 0.06 THEN 'drifting' ELSE 'none' END AS reason, n >= 20 AS input_shifted FROM e""", "v_scored"))
def drift_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = measure.calibration_error(views.scored(spark, sf_dir), ["source"])
    shift = F.when(F.col("n") >= 20, 0.2).otherwise(0.0)
    return e.select("source", measure.drift_verdict(F.col("n"), F.col("ece"), F.lit(0.02), F.lit(False), shift).alias("v")).select("source", "v.*")


_OUTCOMES = "v_outcomes AS (SELECT ['L1_annotate', 'L2_repair', 'L3_reroute'][(request_id % 3 + 1)::INT] AS action, ['ungrounded', 'contradicted'][(k % 2 + 1)::INT] AS defect, k < 70 AS removed FROM v_requests)"


@query(views.sql(f"""WITH {_OUTCOMES}, c AS (SELECT action, defect, count(*) AS n, count_if(removed)::DOUBLE AS k FROM v_outcomes GROUP BY 1, 2) SELECT action, defect, n, round(k / n, 6) AS rate,
    round(greatest(0, (k / n + 3.8416::DOUBLE / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)), 6) AS low, round(least(1, (k / n + 3.8416::DOUBLE / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)), 6) AS high FROM c""", "v_requests"))
def efficacy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.requests(spark, sf_dir)
    return measure.efficacy_cells(r.select(views.pick(schemas.ACTIONS[1:4], F.col("request_id") % 3).alias("action"), views.pick(("ungrounded", "contradicted"), F.col("k") % 2).alias("defect"), (F.col("k") < 70).alias("removed")))


@query("SELECT vec_id, round(1 / (1 + exp(-(0.1 + list_sum(list_transform(embedding, lambda x, i: (x::DOUBLE - 0.01) / 0.5 * ((i - 1) % 7 - 3)))))), 6) AS score FROM embeddings")
def linear_probe_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = measure.probe_scores(views.table(spark, sf_dir, "embeddings"), [0.01] * 64, [0.5] * 64, [i % 7 - 3 for i in range(64)], 0.1)
    return p.withColumn("score", F.round("score", 6))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bootstrap_mean(views.requests(spark, sf_dir), "request_id", "overhead_ms", 200, 7)


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scored(spark, sf_dir)
    return s.select("doc_id", "y2", "p", (F.col("y2") * 0.4 + F.pmod(F.xxhash64("doc_id"), F.lit(600)) / 1000.0).alias("signal"))


@query()
def calibrator_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signals(spark, sf_dir)
    model = measure.Calibrator.fit(s, ["signal", "p"], "y2")
    return s.select("doc_id", "y2", model.probability().alias("probability"))


@query()
def oof_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.out_of_fold(_signals(spark, sf_dir), ["signal", "p"], "doc_id", "y2")


# -- sequences -------------------------------------------------------------------------------------------------------

from tallyglass.plans.text import _SESSION  # noqa: E402

_REWORK = f"""t AS (SELECT *, lag(question) OVER w AS pq, lag(ts) OVER w AS pts, lag(request_id) OVER w AS pid, request_id % 7 = 0 AS regenerate FROM v_turns WINDOW w AS (PARTITION BY session_id ORDER BY ts, request_id)),
    s AS (SELECT *, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN least(1.0, len(list_intersect(x, y))::DOUBLE / sqrt(len(x)::DOUBLE * len(y))) ELSE 0 END, 9) AS score FROM (SELECT *, {_SESSION('question')} AS x, {_SESSION("coalesce(pq, '')")} AS y FROM t WHERE pid IS NOT NULL)),
    k AS (SELECT *, CASE WHEN regenerate THEN 'regenerate' WHEN ts - pts BETWEEN 0 AND 120 AND score >= 0.2 THEN 'retry' END AS kind FROM s),
    c AS (SELECT *, CASE kind WHEN 'regenerate' THEN 0.95::DOUBLE ELSE 0.5::DOUBLE + 0.4::DOUBLE * least(1.0, (score - 0.2::DOUBLE) / 0.8::DOUBLE) END AS confidence FROM k WHERE kind IS NOT NULL)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("long")
    return views.turns(spark, sf_dir).select("*", (F.col("request_id") % 13 * 0.3).alias("cost_inr"), (F.col("request_id") % 7 == 0).alias("regenerate"), none.alias("raised_hold"), none.alias("resolves_hold"))


@query(views.sql(f"WITH {_REWORK} SELECT session_id, request_id AS child, pid AS parent, kind, round(confidence, 6) AS confidence, round((request_id % 13)::DOUBLE * 0.3::DOUBLE * confidence, 4) AS inr_charged FROM c", "v_turns"))
def rework_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a similarity of 0.2, as invented questions are hardly ever asked again."""
    return sequences.rework_edges(_turns(spark, sf_dir), 0.2)


@query(views.sql("SELECT a.session_id, a.request_id AS child, b.request_id AS parent, 'human_escalation' AS kind, 1.0::DOUBLE AS confidence, round((a.request_id % 13)::DOUBLE * 0.3::DOUBLE + 220, 4) AS inr_charged FROM v_turns a JOIN v_turns b ON a.session_id = b.session_id AND b.turn = a.turn - 4 AND a.turn % 4 = 0", "v_turns"))
def escalation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that resolve the hold raised four turns earlier, whatever the time between."""
    t = _turns(spark, sf_dir).withColumns({"raised_hold": F.when(F.col("turn") % 4 == 0, F.col("turn")).cast("long"), "resolves_hold": F.when(F.col("turn") % 4 == 0, F.col("turn") - 4).cast("long"), "regenerate": F.lit(False)})
    return sequences.rework_edges(t, 2.0)


@query("""WITH x AS (SELECT user_id, event_type AS digest, event_id AS idx FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, digest ORDER BY idx) AS n FROM x), c AS (SELECT user_id, min(idx) AS cut_at FROM n WHERE n = 3 GROUP BY 1)
    SELECT s.user_id, s.calls, c.cut_at, coalesce(s.last - c.cut_at, 0) AS remaining FROM (SELECT user_id, count(*) AS calls, max(idx) AS last FROM x GROUP BY 1) s LEFT JOIN c ON c.user_id = s.user_id""")
def loop_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.loop_breaks(views.table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("digest"), F.col("event_id").alias("idx")), "user_id")


_PROV = "['system', 'user', 'retrieved_verified', 'retrieved_untrusted', 'tool_external']"


@query(f"SELECT conv_id, turn, {_PROV}[(max(CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 + turn % 3 END) OVER (PARTITION BY conv_id ORDER BY turn) + 1)::INT] AS taint FROM conversations")
def cumulative_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("role") == "system", "system").when(F.col("role") == "user", "user").otherwise(views.pick(schemas.PROVENANCE[2:], F.col("turn") % 3))
    c = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", label.alias("provenance"))
    return sequences.cumulative_taint(c, "conv_id", ["turn"]).select("conv_id", "turn", "taint")


@query("""WITH m AS (SELECT event_id, event_type AS mode, user_id % 3 AS level, dense_rank() OVER (ORDER BY event_type) - 1 AS mi, user_id % 3 AS li, row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY event_id) - 1 AS o FROM events)
    SELECT event_id, mode, level, row_number() OVER (ORDER BY o, (li - mi + 30) % 3, mi) - 1 AS place FROM m ORDER BY o, (li - mi + 30) % 3, mi LIMIT 100""")
def stratified_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred of a round robin: a sampling operator."""
    e = views.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("mode"), (F.col("user_id") % 3).alias("level"))
    return sequences.stratified_prefix(e, "mode", "level", "event_id", 100).withColumn("place", F.col("place").cast("long")).select("event_id", "mode", "level", "place")


@query(views.sql("""WITH x AS (SELECT doc_id, domain, row_number() OVER (PARTITION BY domain ORDER BY left(sha256(doc_id::VARCHAR), 16), doc_id) AS r, count(*) OVER (PARTITION BY domain) AS n FROM v_fragments WHERE doc_id % 20 <> 0)
    SELECT doc_id, domain, CASE WHEN r <= CASE WHEN n >= 2 THEN greatest(1, least(n - 1, round_even(n * 0.6::DOUBLE, 0))) ELSE round_even(n * 0.6::DOUBLE, 0) END THEN 'calibration' ELSE 'evaluation' END AS split FROM x
    UNION ALL SELECT doc_id, domain, 'evaluation' FROM v_fragments WHERE doc_id % 20 = 0""", "v_fragments"))
def domain_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.domain_split(views.fragments(spark, sf_dir).select("doc_id", "domain"), 0.6, F.col("doc_id") % 20 == 0)


_DELTAS = "v_deltas AS (SELECT event_id // 6 AS request_id, event_id % 2 AS call, event_id % 6 AS seq, CASE WHEN event_id % 5 < 2 THEN event_type END AS name, props AS args FROM events)"


@query(f"WITH {_DELTAS} SELECT request_id, call, list(name ORDER BY seq) FILTER (name IS NOT NULL)[-1] AS name, string_agg(args, '' ORDER BY seq) AS arguments, count(name) > 0 AS complete FROM v_deltas GROUP BY 1, 2".replace("list(name ORDER BY seq) FILTER (name IS NOT NULL)[-1]", "arg_max(name, seq)"))
def tool_call_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    d = views.table(spark, sf_dir, "events").select(F.expr("event_id div 6").alias("request_id"), (i % 2).alias("call"), (i % 6).alias("seq"), F.when(i % 5 < 2, F.col("event_type")).alias("name"), F.col("props").alias("args"))
    return sequences.assembled_calls(d)


@query("SELECT user_id, seq FROM (SELECT user_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 50 AND seq > user_id * 60")
def replay_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"))
    return sequences.replay(e, "user_id", F.col("user_id") * 60, 50)


@query("SELECT user_id, event_id AS arrival, seq FROM (SELECT *, max(seq) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT user_id, event_id, event_id * 7919 % 10007 AS seq FROM events)) WHERE b IS NULL OR seq > b")
def event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("arrival"), (F.col("event_id") * 7919 % 10007).alias("seq"))
    return sequences.new_events(e, "user_id", "arrival")


@query(views.sql("SELECT tenant, request_id, recent, recent >= 5 AS trips FROM (SELECT tenant, request_id, count(*) OVER (PARTITION BY tenant ORDER BY floor(epoch(ts)) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent FROM v_requests WHERE degraded)", "v_requests"))
def breaker_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.requests(spark, sf_dir).filter("degraded").select("tenant", "request_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("ts"))
    return sequences.breaker_trips(r, "tenant", 3600, 5).select("tenant", "request_id", "recent", "trips")


@query()
def governor_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.governor_trace(views.requests(spark, sf_dir), "tenant")


# -- evaluation ------------------------------------------------------------------------------------------------------

_CASES = "v_cases AS (SELECT request_id AS case_id, k % 5 < 2 AS defective, CASE WHEN k % 5 < 2 THEN k % 7 < 6 ELSE k % 3 = 0 END AS intervened, p_ungrounded, amount_inr, event_type AS category FROM v_requests)"


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return views.requests(spark, sf_dir).select(F.col("request_id").alias("case_id"), (k % 5 < 2).alias("defective"), F.when(k % 5 < 2, k % 7 < 6).otherwise(k % 3 == 0).alias("intervened"), "p_ungrounded", "amount_inr", F.col("event_type").alias("category"))


@query(views.sql(f"""WITH {_CASES}, c AS (SELECT count_if(defective AND intervened)::BIGINT AS caught, count_if(defective)::BIGINT AS d, count_if(NOT defective AND intervened)::BIGINT AS f, count_if(NOT defective)::BIGINT AS c FROM v_cases)
    SELECT 'catch_rate' AS metric, caught AS numerator, d AS denominator, round(caught::DOUBLE / d, 6) AS value FROM c UNION ALL SELECT 'escape_rate', d - caught, d, round((d - caught)::DOUBLE / d, 6) FROM c
    UNION ALL SELECT 'false_intervention_rate', f, c, round(f::DOUBLE / c, 6) FROM c UNION ALL SELECT 'intervention_rate', caught + f, d + c, round((caught + f)::DOUBLE / (d + c), 6) FROM c""", "v_requests"))
def six_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.headline(_cases(spark, sf_dir))


@query(views.sql(f"WITH {_CASES} SELECT CASE WHEN amount_inr < 1000 THEN 'a_under_1000' WHEN amount_inr < 10000 THEN 'b_under_10000' WHEN amount_inr < 100000 THEN 'c_under_100000' ELSE 'd_over' END AS band, count(*) AS n, count_if(NOT defective AND intervened)::BIGINT AS false_interventions, count_if(defective AND NOT intervened)::BIGINT AS escapes FROM v_cases GROUP BY 1", "v_requests"))
def stakes_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bands(_cases(spark, sf_dir))


@query(views.sql(f"WITH {_CASES} SELECT category, a AS arm, count(*) AS n, count_if(defective AND NOT (intervened AND a = 'on'))::BIGINT AS escapes, count_if(NOT defective AND intervened AND a = 'on')::BIGINT AS false_interventions FROM v_cases, (VALUES ('on'), ('off')) AS t(a) GROUP BY 1, 2", "v_requests"))
def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.paired(_cases(spark, sf_dir))


@query("SELECT count(*) AS clusters, count_if(n > 1)::BIGINT AS multi_item, max(n) AS largest FROM (SELECT sha256(text) AS c, count(*) AS n FROM documents GROUP BY 1)")
def evidence_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.cluster_stats(views.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("cluster")))


_USAGE = "v_usage AS (SELECT event_id AS item_id, event_id // 5 AS batch_id, (event_id // 5) % 97 * 10 AS prompt_tokens, (event_id // 5) % 31 AS completion_tokens, ((event_id // 5) % 89)::DOUBLE AS latency_ms FROM events)"


@query(f"WITH {_USAGE}, b AS (SELECT DISTINCT batch_id, prompt_tokens, completion_tokens, latency_ms FROM v_usage) SELECT count(*) AS batches, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, (sum(prompt_tokens)::DECIMAL(18,6) * 0.15 / 1000000 + sum(completion_tokens)::DECIMAL(18,6) * 0.60 / 1000000)::DECIMAL(18,6)::VARCHAR AS cost_usd, median(latency_ms) AS median_ms, quantile_disc(latency_ms, 0.95) AS p95_ms FROM b")
def usage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.expr("event_id div 5")
    u = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), b.alias("batch_id"), (b % 97 * 10).alias("prompt_tokens"), (b % 31).alias("completion_tokens"), (b % 89).cast("double").alias("latency_ms"))
    return evaluate.usage(u)


@query(views.sql("SELECT metric, min(v) AS worst, max(v) AS best, CASE WHEN min(v) >= 0.3 THEN 'pass' WHEN max(v) < 0.3 THEN 'miss' ELSE 'inconclusive' END AS status FROM (SELECT event_type AS metric, tenant, round(avg(p_ungrounded), 6) AS v FROM v_requests GROUP BY 1, 2) GROUP BY 1", "v_requests"))
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = views.requests(spark, sf_dir).groupBy(F.col("event_type").alias("metric"), "tenant").agg(F.round(F.avg("p_ungrounded"), 6).alias("value"))
    return evaluate.scorecard(seeds, 0.3)


@query(views.sql("SELECT doc_id, mode, level FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, CASE (row_number() OVER (ORDER BY doc_id) - 1) % 10 WHEN 0 THEN 'number_corrupted' WHEN 1 THEN 'clause_swapped' WHEN 2 THEN 'retrieval_dropped' ELSE 'clean' END AS mode, ((row_number() OVER (ORDER BY doc_id) - 1) // 10) % 3 AS level FROM v_fragments)", "v_fragments"))
def induced_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.assigned_modes(views.fragments(spark, sf_dir).select("doc_id"))


@query()
def induced_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.induced(views.fragments(spark, sf_dir))


@query(views.sql("WITH b AS (SELECT request_id // 8 AS batch, sum(k)::BIGINT AS cost FROM v_requests GROUP BY 1) SELECT batch, cost, sum(cost) OVER (ORDER BY batch)::BIGINT AS spent, sum(cost) OVER (ORDER BY batch) <= 20000 AS allowed FROM b", "v_requests"))
def budgeted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.requests(spark, sf_dir).groupBy(F.expr("request_id div 8").alias("batch")).agg(F.sum("k").alias("cost"))
    return evaluate.budgeted(r, "batch", "cost", 20000)
