"""Registered streaming queries: run to the end of their source and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass import views
from tallyglass.streaming import gate, live

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_K = "json_extract_string(props, '$.k')::BIGINT"


@query(f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, sum({_K})::BIGINT AS k FROM events GROUP BY 1, 2")
def stream_daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = live.latest_of(live.finished(live.windowed(live.events(spark, sf_dir), "1 day"), "update"), ["start", "end", "event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "k")


@query(f"SELECT strftime(d, '%Y-%m-%d %H') AS start, event_type, count(*) AS n, sum({_K})::BIGINT AS k FROM events, (VALUES (0), (1)) AS s(i), LATERAL (SELECT time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '2024-01-01') - i * INTERVAL '12 hours' AS d) GROUP BY 1, 2")
def stream_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = live.latest_of(live.finished(live.windowed(live.events(spark, sf_dir), "24 hours", "12 hours"), "update"), ["start", "end", "event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", "k")


@query("SELECT user_id, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = live.finished(live.deduplicated(live.events(spark, sf_dir), ["event_id"]).select("user_id", "event_id"), "append")
    return out.groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, event_type AS digest FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 3")
def stream_loop_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.finished(live.loop_breaker(live.events(spark, sf_dir)), "append").drop("_batch")


@query("""WITH x AS (SELECT user_id % 5 AS tenant, event_id, (event_type = 'error')::INT::DOUBLE AS x FROM events), p AS (SELECT *, count(*) OVER w AS n, avg(x) OVER w AS m, avg(x * x) OVER w AS q FROM x WINDOW w AS (PARTITION BY tenant ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    b AS (SELECT *, CASE WHEN n < 10 OR m - 0.05::DOUBLE <= 0 THEN 0 ELSE least((m - 0.05::DOUBLE) / (greatest(1e-12, q - m ** 2) + (m - 0.05::DOUBLE) ** 2), 10.0) END AS bet FROM p)
    SELECT tenant, event_id, round(sum(ln(1 + bet * (x - 0.05::DOUBLE))) OVER (PARTITION BY tenant ORDER BY event_id), 6) AS log_e FROM b""")
def stream_evalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = live.finished(live.evalue_monitor(live.events(spark, sf_dir)), "append")
    return out.select("tenant", "event_id", F.round("log_e", 6).alias("log_e"))


@query()
def stream_governor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.finished(live.governor(live.events(spark, sf_dir)), "append").drop("_batch")


def _service_calls(e: DataFrame) -> DataFrame:
    """Calls to five services, one every fifth of a second; of each minute, eight seconds have nothing but failures."""
    i = F.col("event_id")
    return e.select((F.col("user_id") % 5).alias("service"), "event_id", (i * 0.2).cast("double").alias("at"), ((F.col("event_type") == "error") | (i % 300 < 40)).alias("failed"))


@query()
def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.finished(live.breaker(_service_calls(live.events(spark, sf_dir))), "append").drop("_batch")


@query()
def stream_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = live.events(spark, sf_dir)
    return live.finished(live.holds(e.select(
        F.expr("event_id div 4").alias("hold_id"), F.get(F.array(F.lit("open"), F.lit("approve"), F.lit("note"), F.lit("reject")), (F.col("event_id") % 4).cast("int")).alias("event"),
        (F.col("k") % 2 == 0).alias("token_ok"), (F.col("ts") + F.expr("INTERVAL 15 MINUTES")).alias("deadline"), "ts",
    )), "append").drop("_batch")


@query()
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that closed by the watermark; the last ones of a stream stay open."""
    return live.finished(live.sessions(live.events(spark, sf_dir), "30 minutes"), "append").drop("_batch")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return gate.chunked(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "text"))


@query()
def segmenter_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.segmented(_answers(spark, sf_dir))


@query()
def gate_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gated(_answers(spark, sf_dir))
