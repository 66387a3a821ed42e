"""Ledger facts derived from plain tables, once in Spark and once as SQL for comparison.

Every derivation is integer and string arithmetic on a row's own columns, so both forms agree exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS = ("qwen3:4b", "qwen3:8b", "gpt-4o", "gpt-4o-mini-2024", "claude-sonnet-4", "mystery-1")
DOMAINS = ("loan_terms", "prepayment", "claims", "fees", "payments", "branch_info", "general")
COMPONENTS = ("observer", "verifier", "judge", "repair", "embedding")
TOOLS = ("lookup_balance", "raise_ticket", "send_email", "transfer_funds", "unheard_of")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(
        i.alias("request_id"), u.alias("session_id"), (u % 5).alias("tenant"), "ts", F.col("value").alias("overhead_ms"), ((i * 7919) % 900).cast("double").alias("ttft_ms"),
        pick(MODELS, i % 6).alias("model"), (F.lit(100) + F.col("k") * 10).alias("prompt_tokens"), (F.lit(20) + F.col("k")).alias("completion_tokens"),
        (F.col("event_type") == "view").alias("cache_hit"), (F.col("event_type") == "error").alias("degraded"), pick(DOMAINS, u % 7).alias("domain"), "k", "event_type",
        ((i * 37) % 1000 / 1000.0).alias("p_ungrounded"), ((i * 53) % 1000 / 2000.0).alias("p_contradicted"), ((i * 71) % 1000 / 1000.0).alias("p_overconfident"),
        (F.col("k") * F.col("k") * 15).cast("double").alias("amount_inr"),
    )


def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir)
    up = r.select("request_id", F.lit("upstream").alias("component"), "model", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), (F.col("k") / 64.0).alias("inr"))
    checks = r.select("request_id", pick(COMPONENTS, (F.col("request_id") / 3).cast("long") % 5).alias("component"), "model", F.col("k").alias("tokens"), (F.col("k") / 1024.0).alias("inr"))
    return up.unionByName(checks)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn"), (F.col("turn") * 40).alias("ts"), F.col("text").alias("question"), (F.col("conv_id") * 100 + F.col("turn")).alias("request_id"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score: y = toxic, y2 = low quality."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(
        "doc_id", "lang", "source", F.col("toxic").cast("long").alias("y"), (1 - F.col("quality")).cast("long").alias("y2"), (F.col("n_chars") % 1000 / 1000.0).alias("p"),
    )


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "text", F.col("source").alias("domain"), F.when(F.col("doc_id") % 20 == 0, "retrieved_untrusted").otherwise("retrieved_verified").alias("provenance"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SQL = {
    "v_requests": f"""SELECT event_id AS request_id, user_id AS session_id, user_id % 5 AS tenant, ts, value AS overhead_ms, ((event_id * 7919) % 900)::DOUBLE AS ttft_ms,
        {_list(MODELS)}[(event_id % 6 + 1)::INT] AS model, 100 + k * 10 AS prompt_tokens, 20 + k AS completion_tokens, event_type = 'view' AS cache_hit, event_type = 'error' AS degraded,
        {_list(DOMAINS)}[(user_id % 7 + 1)::INT] AS domain, k, event_type, ((event_id * 37) % 1000)::DOUBLE / 1000.0::DOUBLE AS p_ungrounded, ((event_id * 53) % 1000)::DOUBLE / 2000.0::DOUBLE AS p_contradicted,
        ((event_id * 71) % 1000)::DOUBLE / 1000.0::DOUBLE AS p_overconfident, (k * k * 15)::DOUBLE AS amount_inr
        FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)""",
    "v_spend": f"""SELECT request_id, 'upstream' AS component, model, prompt_tokens + completion_tokens AS tokens, k::DOUBLE / 64.0::DOUBLE AS inr FROM v_requests
        UNION ALL SELECT request_id, {_list(COMPONENTS)}[((request_id // 3) % 5 + 1)::INT], model, k, k::DOUBLE / 1024.0::DOUBLE FROM v_requests""",
    "v_turns": "SELECT conv_id AS session_id, turn, turn * 40 AS ts, text AS question, conv_id * 100 + turn AS request_id FROM conversations WHERE role = 'user'",
    "v_scored": """SELECT l.doc_id, d.lang, d.source, l.toxic::BIGINT AS y, (1 - l.quality)::BIGINT AS y2, (d.n_chars % 1000)::DOUBLE / 1000.0::DOUBLE AS p
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "v_fragments": "SELECT doc_id, text, source AS domain, CASE WHEN doc_id % 20 = 0 THEN 'retrieved_untrusted' ELSE 'retrieved_verified' END AS provenance FROM documents",
}


def sql(body: str, *names: str) -> str:
    """The body after the definitions of the views that it names; v_spend needs v_requests."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + (", " + body[5:] if body.startswith("WITH ") else " " + body)
