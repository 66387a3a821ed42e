"""Tables of the ledger, their keys, and the ordered domains that operators rank by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ordered domains, weakest first.
ACTIONS = ("L0_pass", "L1_annotate", "L2_repair", "L3_reroute", "L4_hold", "L5_block")
DEFECTS = ("ungrounded", "contradicted", "overconfident", "unsafe_action", "pii_leak", "canary_leak", "biased")
PROVENANCE = ("system", "user", "retrieved_verified", "retrieved_untrusted", "tool_external")
REVERSIBILITY = ("reversible", "costly", "irreversible")
GOVERNOR = ("normal", "thin", "shallow", "probe_only", "bypass")
TRUST = ("trusted", "watch", "untrusted")

LOSS = "array<struct<action:string,residual_harm:double,nuisance:double,compute:double,latency:double,total:double,available:boolean>>"
TABLES = {
    "schema_migrations": "version string, applied_ts double",
    "requests": "request_id string, trace_id string, session_id string, tenant_id string, user_role string, ts double, model_requested string, model_served string, route_reason string, stakes_impact_inr double, stakes_reversibility string, stakes_domain string, stakes_confidence double, gate_mode string, prompt_tokens long, completion_tokens long, upstream_ms long, overhead_ms double, lane_a_ms double, ttft_ms double, cache_hit boolean, degraded boolean, dropped_detectors array<string>, prompt_hash string, prompt_text string, finish_reason string",
    "signals": "request_id string, seq int, name string, sentence_idx int, raw double, prob double, calib_version string, latency_ms double, span_start int, span_end int",
    "decisions": f"decision_id string, request_id string, sentence_idx int, action string, loss_table {LOSS}, chosen_loss double, runner_up string, margin double, probs map<string,double>, why array<string>, hard_rule string, policy_version string, calib_version string, probe_version string, inputs_digest string, latency_ms double, ts double",
    "spend": "request_id string, component string, model string, tokens long, inr double, ts double",
    "tool_calls": "tool_call_id string, request_id string, tool_name string, args string, reversibility string, taint string, taint_reason string, verdict string, hold_id string, resolved_by string, resolved_ts double, ts double",
    "holds": "hold_id string, request_id string, kind string, payload string, flagged_span string, evidence array<string>, state string, resume_token string, reason string, created_ts double, sla_deadline_ts double, resolved_by string, resolved_ts double",
    "rework_edges": "child_request_id string, parent_request_id string, kind string, confidence double, inr_charged double, ts double",
    "shadow_runs": "request_id string, cheaper_model string, verdict string, judged_by string, inr_saved_if_switched double, ts double",
    "fairness_pairs": "pair_id string, base_request_id string, twin_request_id string, attribute string, decision_field string, base_value string, twin_value string, delta double, ts double",
    "labels": "item_id string, source string, split string, payload string, gold_ungrounded int, gold_contradicted int, gold_unsafe int, labeller string, ts double",
    "spans": "span_id string, trace_id string, parent_span_id string, name string, start_ts double, end_ts double, duration_ms double, status string, attributes string",
}
#: What makes a row of a table the same row again; spend is a bag.
KEYS = {
    "schema_migrations": ["version"], "requests": ["request_id"], "signals": ["request_id", "seq", "name"], "decisions": ["decision_id"], "spend": [],
    "tool_calls": ["tool_call_id"], "holds": ["hold_id"], "rework_edges": ["child_request_id", "parent_request_id", "kind"], "shadow_runs": ["request_id", "cheaper_model"],
    "fairness_pairs": ["pair_id"], "labels": ["item_id"], "spans": ["span_id"],
}


def rank(column: Column | str, domain: tuple[str, ...]) -> Column:
    """Place of a value in an ordered domain, from 0; null if it isn't in it."""
    at = F.array_position(F.array(*[F.lit(x) for x in domain]), F.col(column) if isinstance(column, str) else column)
    return F.when(at > 0, (at - 1).cast("int"))


def at_rank(column: Column, domain: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in domain]), column)


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])
