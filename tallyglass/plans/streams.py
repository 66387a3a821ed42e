"""Registered queries over real streams: recordings replayed, the commit gate, bounded ingest, live rework, canaries on the way out."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass import storage, views
from tallyglass.operators import canaries
from tallyglass.plans.live import _answers
from tallyglass.plans.trust import SQL as TRUST_SQL
from tallyglass.plans.trust import _turns
from tallyglass.sources import recordings
from tallyglass.streaming import commit, gate, ingest, live, turns

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# -- recordings and the gate ---------------------------------------------------------------------------------------------

#: Milliseconds that a replay of a whole recording takes.
_REPLAY_MS = 3000


def _recording(spark: SparkSession, sf_dir: str) -> str:
    """Every assistant's answer as a recorded stream, a chunk every 20 ms from a start of its own."""
    folder = f"{storage.shared_folder(spark)}/recording-{uuid.uuid4().hex}"
    begins = F.pmod(F.xxhash64("request_id"), F.lit(1000)) / 2
    chunks = _answers(spark, sf_dir).select(F.col("request_id").cast("string").alias("stream"), "seq", (begins + F.col("seq") * 20).alias("at_ms"), "delta")
    recordings.record(chunks, folder)
    return folder


def _end(folder: str) -> dict:
    return recordings._Replay(folder, float("inf"), 0).latestOffset()


def _replay(spark: SparkSession, folder: str, began: float) -> DataFrame:
    return recordings.replayed(spark, folder, max(1e-3, _end(folder)["at_us"] / 1000 / _REPLAY_MS), began)


def _joined(parts: DataFrame, order: str, text: str) -> DataFrame:
    """Per request the number of its parts and the digest of their texts in order."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    return parts.groupBy("request_id").agg(F.count("*").alias("parts"), F.md5(F.array_join(F.transform(ordered, lambda x: x[text]), "")).alias("text_md5"))


_ANSWERS = """SELECT conv_id * 1000 + turn AS request_id, (greatest(0, length(text) - 1) // 17 + 1)::BIGINT AS parts, md5(text) AS text_md5
    FROM conversations WHERE role = 'assistant' AND text <> ''"""


@query(_ANSWERS)
def recorded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put together again from a recording that is read in one go."""
    read = recordings.recorded(spark, _recording(spark, sf_dir)).filter("not done and delta <> ''")
    return _joined(read.select(F.col("stream").cast("long").alias("request_id"), "place", "delta"), "place", "delta")


@query(_ANSWERS)
def replayed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a replay that is stopped in the middle of the files and goes on from its checkpoint."""
    folder, run = _recording(spark, sf_dir), live.checkpoint_folder(spark)
    began = time.time() * 1000
    first = commit.into(_replay(spark, folder, began), run)
    while not first.lastProgress and first.isActive:
        time.sleep(0.05)
    first.stop()
    commit.drained(commit.into(_replay(spark, folder, began), run), _end(folder))
    read = spark.read.parquet(f"{run}/out").filter("not done and delta <> ''")
    return _joined(read.select(F.col("stream").cast("long").alias("request_id"), "place", "delta"), "place", "delta")


def _gate(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    folder, run = _recording(spark, sf_dir), live.checkpoint_folder(spark)
    rows = commit.chunk_rows(_replay(spark, folder, time.time() * 1000))
    commit.drained(commit.into(commit.gated(rows, **how), run), _end(folder))
    return spark.read.schema(f"{commit.SENT}, batch int").parquet(f"{run}/out").drop("batch")


@query(_ANSWERS)
def gate_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unbuffered gate over the replay sends every chunk once, as it came, while sentences are judged beside it."""
    sent = _gate(spark, sf_dir, buffered=False, decide=lambda s: "L0_pass")
    return _joined(sent.filter("kind = 'raw'"), "n", "text")


@query()
def gate_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buffered gate over the replay, by the patterns of the batch gate (gate_emissions), whose rows it has to equal."""
    return _gate(spark, sf_dir, buffered=True, decide=gate.by_patterns()).select("request_id", "idx", "kind", "text")


# -- bounded ingest ------------------------------------------------------------------------------------------------------

#: Which lines of the events are broken, and how: facts of their own columns.
_BROKEN = {
    "malformed": "k = 13", "no id": "k = 29", "no time": "k = 31", "unknown action": "k = 37 AND event_type = 'error'", "negative amount": "k = 41",
    "child of another request": "k = 43", "too large": "k = 47 AND event_type = 'view'",
}
_LIMITS = ingest.Limits(queue=1 << 40, line_bytes=4096)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of JSON for each event; lines of some are broken, twice there, or there in two versions."""
    r = views.requests(spark, sf_dir).withColumn("inr", F.col("k") / 64.0)
    is_ = lambda reason: F.expr(_BROKEN[reason])
    i = F.col("request_id").cast("string")
    owner = F.when(is_("child of another request"), F.concat(i, F.lit("x"))).otherwise(i)
    action = F.when(is_("unknown action"), F.lit("L9_none")).otherwise(F.when(F.col("cache_hit"), F.lit("L0_pass")).otherwise(F.lit("L2_repair")))

    def line(inr):
        spend = F.array(F.struct(owner.alias("request_id"), F.lit("upstream").alias("component"), "model", "prompt_tokens", F.when(is_("negative amount"), -inr - 1).otherwise(inr).alias("inr")))
        spend = F.transform(spend, lambda x: x.withField("tokens", x["prompt_tokens"]).dropFields("prompt_tokens"))
        decisions = F.array(F.struct(F.concat(F.lit("d"), i).alias("decision_id"), action.alias("action"), F.col("overhead_ms").alias("chosen_loss")))
        return F.to_json(F.struct(
            F.when(~is_("no id"), i).alias("request_id"), F.when(~is_("no time"), F.col("request_id").cast("double")).alias("ts"), F.col("tenant").cast("string").alias("tenant_id"),
            "prompt_tokens", "completion_tokens", "overhead_ms", F.when(is_("too large"), F.repeat(F.lit("long "), 1000)).otherwise(F.col("event_type")).alias("prompt_text"),
            decisions.alias("decisions"), spend.alias("spend"),
        ))

    once = F.when(is_("malformed"), F.substring(line(F.col("inr")), 1, 40)).otherwise(line(F.col("inr")))
    more = F.when(F.col("k") == 53, F.array(once, once, once)).when(F.col("k") == 59, F.array(once, line(F.col("inr") + 1))).otherwise(F.array(once))
    # lines of one request come in one file, so that they meet in one micro-batch
    return r.select("request_id", F.explode(more).alias("value")).repartition(8, "request_id").select("value")


_INGESTED = f"""WITH e AS (SELECT event_id::VARCHAR AS request_id, event_type, value, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
    j AS (SELECT *, CASE {' '.join(f"WHEN {c} THEN '{reason}'" for reason, c in _BROKEN.items())} WHEN k = 59 THEN 'conflicting versions' END AS reason FROM e)"""


@query(f"""{_INGESTED}
    SELECT request_id, CAST(NULL AS VARCHAR) AS reason, 1::BIGINT AS lines, CASE event_type WHEN 'view' THEN 'L0_pass' ELSE 'L2_repair' END AS action, k::DOUBLE / 64.0::DOUBLE AS inr FROM j WHERE reason IS NULL
    UNION ALL SELECT NULL, coalesce(reason, 'repeated'), sum(CASE WHEN k = 53 OR k = 59 THEN 2 ELSE 1 END)::BIGINT, NULL, NULL FROM j WHERE reason IS NOT NULL OR k = 53 GROUP BY 2""")
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through the ingest: each request that was written with its children, and the lines rejected for each reason."""
    folder = f"{storage.shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    _lines(spark, sf_dir).write.text(f"{folder}/lines")
    ingest.ingested(ingest.lines_in(spark, f"{folder}/lines", 4), folder, f"ingest-{uuid.uuid4().hex}", _LIMITS)
    dead = ingest.table(spark, folder, "dead_letters").groupBy("reason").agg(F.sum("times").alias("lines"))
    headers, spend, decisions = (ingest.table(spark, folder, t) for t in ("requests", "spend", "decisions"))
    inr = spend.groupBy("request_id").agg(F.sum("inr").alias("inr"))
    action = decisions.groupBy("request_id").agg(F.max("action").alias("action"))
    good = headers.select("request_id").join(action, "request_id", "left").join(inr, "request_id", "left").withColumns({"reason": F.lit(None).cast("string"), "lines": F.lit(1).cast("long")})
    return good.select("request_id", "reason", "lines", "action", "inr").unionByName(dead, allowMissingColumns=True)


# -- live rework ---------------------------------------------------------------------------------------------------------


@query(TRUST_SQL["rework_edges"])
def live_rework_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of rework_edges while the turns come in, a fifth of the time span after the other."""
    folder = live.checkpoint_folder(spark)
    rows = _turns(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.col("ts") + 86_400))  # what is at the epoch itself counts as late
    last = rows.agg(F.max("ts")).first()[0] or 0
    for k in range(5):  # files of their own, so that the stream reads them in the order of time
        part = F.least(F.lit(4), F.floor(F.col("ts") * 5 / (last + 1)))
        rows.filter(part == k).write.mode("append").parquet(f"{folder}/turns")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/turns")
    return live.finished(turns.rework_edges(stream, 0.2), "append").drop("_batch")


# -- canaries ------------------------------------------------------------------------------------------------------------

_CANARIES = """p AS (SELECT item_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
    c AS (SELECT canary, min(item_id % 3)::VARCHAR AS owner FROM (
        SELECT item_id, array_to_string(w[i:i + 4], ' ') AS canary FROM p, unnest(range(1, len(w) - 3)) AS t(i)) GROUP BY canary)"""
_HITS = """h AS (SELECT d.doc_id AS text_id, canary, owner, (instr(text, canary) - 1)::INT AS start, (instr(text, canary) - 1 + length(canary))::INT AS "end",
        owner <> (d.doc_id % 3)::VARCHAR AS cross_tenant FROM documents d JOIN c ON contains(d.text, c.canary))"""


def _egress(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents as texts of three tenants, and every run of five words of the benchmark as a canary."""
    texts = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), (F.col("doc_id") % 3).alias("tenant"), "text")
    w = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    items = views.table(spark, sf_dir, "benchmark").select((F.col("item_id") % 3).cast("string").alias("owner"), w.alias("w")).filter(F.size("w") >= 5)
    runs = items.select("owner", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.array_join(F.slice("w", i, 5), " "))).alias("canary"))
    return texts, runs.groupBy("canary").agg(F.min("owner").alias("owner"))


@query(f"WITH {_CANARIES}, {_HITS} SELECT * FROM h")
def canary_egress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canaries.hits(*_egress(spark, sf_dir))


@query(f"""WITH {_CANARIES}, {_HITS}, f AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY start, "end", canary) AS r FROM h),
    a AS (SELECT text_id, count(*) AS canaries, bool_or(cross_tenant) AS cross_tenant FROM h GROUP BY 1)
    SELECT a.text_id, 'L5_block' AS action, CASE WHEN f.cross_tenant THEN 'another tenant''s' ELSE 'the tenant''s own' END || ' canary '
        || CASE WHEN length(f.canary) > 20 THEN f.canary[1:12] || '...' || f.canary[-4:] ELSE f.canary[1:4] || '...' END AS reason, a.canaries, a.cross_tenant
    FROM a JOIN f ON f.text_id = a.text_id AND f.r = 1""")
def canary_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canaries.verdicts(canaries.hits(*_egress(spark, sf_dir)))


@query(f"""WITH {_CANARIES}, {_HITS}, o AS (SELECT owner, count(*) AS registered FROM c GROUP BY 1),
    m AS (SELECT owner, count(DISTINCT canary) AS planted FROM h WHERE NOT cross_tenant GROUP BY 1)
    SELECT t.tenant, coalesce(registered, 0)::BIGINT AS registered, coalesce(planted, 0)::BIGINT AS planted
    FROM (SELECT DISTINCT (doc_id % 3)::VARCHAR AS tenant FROM documents) t LEFT JOIN o ON o.owner = t.tenant LEFT JOIN m ON m.owner = t.tenant""")
def canary_plantings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canaries.planted(*_egress(spark, sf_dir))
