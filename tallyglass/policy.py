"""The shipped policy and price book, and their tables."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tallyglass import schemas

#: Fixed values of the policy: prices in rupees, latencies in ms.
POLICY = {
    "version": "banking-v4", "currency": "INR", "lambda_time_inr_per_second": 0.40,
    "decision_adjustment": {"impact_scale": 1.0, "probability_deadband": 0.015, "nuisance_multiplier": 20.0},
    "default_impact_inr": 200.0,
    "domains": {
        "loan_terms": (40000.0, "costly"), "prepayment": (40000.0, "costly"), "claims": (12000.0, "costly"), "fees": (3000.0, "costly"),
        "payments": (25000.0, "irreversible"), "branch_info": (50.0, "reversible"), "general": (200.0, "reversible"),
    },
    "reversibility": {"reversible": 1.0, "costly": 2.5, "irreversible": 8.0},
    "defect": {"ungrounded": 1.0, "contradicted": 1.4, "overconfident": 1.2, "unsafe_action": 3.0, "pii_leak": 6.0, "canary_leak": 10.0, "biased": 4.0},
    "bands": {10000.0: 1.5, 100000.0: 3.0},
    "nuisance_inr": {"L0_pass": 0.0, "L1_annotate": 0.5, "L2_repair": 2.0, "L3_reroute": 4.0, "L4_hold": 220.0, "L5_block": 1500.0},
    "compute_tokens": {"L0_pass": 0, "L1_annotate": 0, "L2_repair": 120, "L3_reroute": 900, "L4_hold": 0, "L5_block": 0},
    "price_inr_per_1k_tokens": 0.60,
    "latency_ms": {"L0_pass": 0, "L1_annotate": 5, "L2_repair": 13704, "L3_reroute": 30719, "L4_hold": 240000, "L5_block": 0},
    "efficacy": {
        "L0_pass": {}, "L1_annotate": {"ungrounded": 0.20, "contradicted": 0.15, "overconfident": 0.55},
        "L2_repair": {"ungrounded": 0.80, "contradicted": 0.85, "overconfident": 0.60}, "L3_reroute": {"ungrounded": 0.70, "contradicted": 0.75, "overconfident": 0.55},
        "L4_hold": {"ungrounded": 0.98, "contradicted": 0.98, "overconfident": 0.95, "unsafe_action": 0.99, "pii_leak": 0.98, "biased": 0.90},
        "L5_block": {"ungrounded": 1.0, "contradicted": 1.0, "overconfident": 1.0, "unsafe_action": 1.0, "pii_leak": 1.0, "canary_leak": 1.0, "biased": 1.0},
    },
    "tools": {
        "lookup_balance": ("reversible", None), "lookup_transactions": ("reversible", None), "search_documents": ("reversible", None), "raise_ticket": ("costly", None),
        "send_email": ("irreversible", None), "transfer_funds": ("irreversible", 0.0), "delete_record": ("irreversible", None), "http_post_external": ("irreversible", None),
        "default": ("costly", None),
    },
    "review_cost_inr": 220.0, "sla_minutes": 15, "escape_rate": 0.01, "confidence": 0.90, "buffer_above_impact_inr": 1000.0, "strong_model_above_impact_inr": 1000.0,
}

#: Rupees per 1,000 prompt and completion tokens, in book order, and the price of a model that isn't in it.
PRICES = (
    ("qwen3:4b", 0.35, 1.40, True), ("qwen3:8b", 0.75, 3.00, True), ("gpt-4o", 0.21, 0.84, False),
    ("gpt-4o-mini", 0.0126, 0.0504, False), ("claude-sonnet-4", 0.252, 1.26, False), ("claude-haiku-4-5", 0.084, 0.42, False),
)
FALLBACK_PRICE = (0.75, 3.00)
STRONG, CHEAP = "qwen3:8b", "qwen3:4b"


def digest(text: str) -> str:
    """Digest of a policy text; line ends of any system are the same."""
    return hashlib.sha256(text.replace("\r\n", "\n").encode()).hexdigest()


def load(path: str) -> dict:
    """A policy from JSON, or YAML where the library is there, checked; efficacies may be plain numbers."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        given = yaml.safe_load(text)
    else:
        given = json.loads(text)
    given["efficacy"] = {a: {d: float(v["value"] if isinstance(v, dict) else v) for d, v in (row or {}).items()} for a, row in given.get("efficacy", {}).items()}
    check(given)
    return given | {"digest": digest(text)}


def check(policy: dict) -> None:
    """Every action is priced, every reversibility has a multiplier, and there is a default tool."""
    for table in ("nuisance_inr", "compute_tokens", "latency_ms"):
        if missing := [a for a in schemas.ACTIONS if a not in policy.get(table, {})]:
            raise ValueError(f"{table} prices no {', '.join(missing)}")
    if missing := [r for r in schemas.REVERSIBILITY if r not in policy.get("reversibility", policy.get("stakes", {}).get("multipliers", {}).get("reversibility", {}))]:
        raise ValueError(f"no multiplier for {', '.join(missing)}")
    if "default" not in policy.get("tools", {}):
        raise ValueError("no default tool")


def alpha_delta(policy: dict = POLICY) -> tuple[float, float]:
    return policy["escape_rate"], round(1 - policy["confidence"], 10)


def actions(spark: SparkSession, policy: dict = POLICY) -> DataFrame:
    """(action, ladder, nuisance_inr, compute_tokens, latency_ms, review_inr): six rows."""
    review = policy["review_cost_inr"]
    rows = [(a, i, policy["nuisance_inr"][a], float(policy["compute_tokens"][a]), float(policy["latency_ms"][a]), review if a in ("L4_hold", "L5_block") else 0.0) for i, a in enumerate(schemas.ACTIONS)]
    return spark.createDataFrame(rows, "action string, ladder int, nuisance_inr double, compute_tokens double, latency_ms double, review_inr double")


def efficacy(spark: SparkSession, policy: dict = POLICY) -> DataFrame:
    rows = [(a, d, float(v)) for a, row in policy["efficacy"].items() for d, v in row.items()]
    return spark.createDataFrame(rows, "action string, defect string, efficacy double")


def defects(spark: SparkSession, policy: dict = POLICY) -> DataFrame:
    return spark.createDataFrame(list(policy["defect"].items()), "defect string, defect_multiplier double")


def domains(spark: SparkSession, policy: dict = POLICY) -> DataFrame:
    return spark.createDataFrame([(d, i, r) for d, (i, r) in policy["domains"].items()], "domain string, base_impact double, base_reversibility string")


def tools(spark: SparkSession, policy: dict = POLICY) -> DataFrame:
    rows = [(t, r, m) for t, (r, m) in policy["tools"].items()]
    return spark.createDataFrame(rows, "tool string, reversibility string, max_auto_inr double")


def prices(spark: SparkSession, book: tuple = PRICES) -> DataFrame:
    rows = [(m, i, p, c, g) for i, (m, p, c, g) in enumerate(book)]
    return spark.createDataFrame(rows, "book_model string, book_order int, prompt_inr double, completion_inr double, imputed boolean")
