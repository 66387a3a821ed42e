"""Bounded ingest of request lines into the ledger: nothing stops it, nothing is lost silently, nothing is written twice.

Lines of JSON come as a stream whose source limits what a micro-batch takes in. Within a batch each intake partition has room
for so many lines; what doesn't fit is rejected and counted, as is every line that fails a check. A micro-batch becomes
visible all at once: tables and dead letters are written below folders of the batch, and then one manifest with its counts.
Readers take batches that have a manifest, and of each request the version that counts. A repeated batch overwrites itself.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tallyglass import schemas, storage
from tallyglass.operators import ledger

LINE = (
    "request_id string, ts double, tenant_id string, session_id string, model_served string, prompt_tokens long, completion_tokens long, overhead_ms double, prompt_text string,"
    " signals array<struct<request_id:string,name:string,raw:double,prob:double>>, decisions array<struct<request_id:string,decision_id:string,action:string,chosen_loss:double>>,"
    " spend array<struct<request_id:string,component:string,model:string,tokens:long,inr:double>>, _broken string"
)
CHILDREN = ("signals", "decisions", "spend")
#: Reasons in the order in which they are looked for.
REASONS = (
    "queue full", "too large", "malformed", "no id", "no time", "too many children", "child of another request", "unknown action", "negative amount",
    "conflicting versions", "repeated",
)


@dataclass(frozen=True)
class Limits:
    """Lines that an intake partition takes in a micro-batch, bytes of a line, and children of each kind of a request."""

    queue: int = 100_000
    line_bytes: int = 1 << 20
    children: int = 1000


def _rejected(limits: Limits) -> Column:
    """The first reason against a line on its own."""
    r = lambda name: F.col(f"r.{name}")
    many = F.greatest(*[F.coalesce(F.size(r(c)), F.lit(0)) for c in CHILDREN]) > limits.children
    other = lambda c: F.coalesce(F.exists(r(c), lambda x: x["request_id"].isNotNull() & (x["request_id"] != r("request_id"))), F.lit(False))
    unknown = F.coalesce(F.exists(r("decisions"), lambda x: x["action"].isNull() | ~x["action"].isin(*schemas.ACTIONS)), F.lit(False))
    negative = F.coalesce(F.exists(r("spend"), lambda x: (x["tokens"] < 0) | (x["inr"] < 0)), F.lit(False))
    negative = negative | F.coalesce((r("prompt_tokens") < 0) | (r("completion_tokens") < 0), F.lit(False))
    return (
        F.when(F.col("place") >= limits.queue, "queue full").when(F.octet_length("value") > limits.line_bytes, "too large")
        .when(F.col("r").isNull() | r("_broken").isNotNull(), "malformed").when(r("request_id").isNull() | (r("request_id") == ""), "no id")
        .when(r("ts").isNull() | F.isnan(r("ts")), "no time").when(many, "too many children").when(other("signals") | other("decisions") | other("spend"), "child of another request")
        .when(unknown, "unknown action").when(negative, "negative amount")
    )


def sorted_out(lines: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(value, r, version, reason, times) of lines (value): a null reason is for rows to be written.

    Equal lines become one row; the others of them count as repeated. Two lines that differ but name one request and time
    contradict each other, so that neither is written. Lines of one request are summed up before they meet. This holds within
    one micro-batch; over several, the version of the greatest time, batch and digest counts (see table()).
    """
    return _judged(_summed(lines, limits))


def _parsed() -> Column:
    return F.from_json("value", LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})


def _summed(lines: DataFrame, limits: Limits) -> DataFrame:
    """(reason, request_id, ts, value, n): equal lines as one row, rejected ones by what is kept of them; each line is parsed once."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    # a line over the bound isn't parsed at all
    parsed = lines.select("value", place.alias("place")).withColumn("r", F.when(F.octet_length("value") <= limits.line_bytes, _parsed()))
    told = parsed.select("value", "r", _rejected(limits).alias("reason"))
    alone, of = F.col("reason").isNotNull(), lambda c: F.when(F.col("reason").isNull(), F.col(c))
    kept = told.select("reason", of("r.request_id").alias("request_id"), of("r.ts").alias("ts"), F.when(alone, F.substring("value", 1, 4096)).otherwise(F.col("value")).alias("value"))
    return kept.groupBy("reason", "request_id", "ts", "value").agg(F.count("*").alias("n"))


def _judged(summed: DataFrame) -> DataFrame:
    """What becomes of summed lines, which are read twice: once for requests that contradict themselves, once for the rows."""
    alone = summed.filter("reason is not null").select("value", "reason", F.col("n").alias("times"))
    same = summed.filter("reason is null").select("request_id", "ts", "value", "n")
    versions = same.groupBy("request_id", "ts").agg(F.count("*").alias("_versions")).filter("_versions > 1")
    s, v = same.alias("s"), versions.alias("v")
    judged = s.join(v, (F.col("s.request_id") == F.col("v.request_id")) & (F.col("s.ts") == F.col("v.ts")), "left").select("value", "n", F.col("_versions").isNotNull().alias("_conflict"))
    # one pass over the join: a line gives a row to be written, or one for what is rejected, or both
    times = F.when(F.col("_conflict"), F.array(F.struct(F.lit("conflicting versions").alias("reason"), F.col("n").alias("times"))))
    times = times.when(F.col("n") > 1, F.array(F.struct(F.lit(None).cast("string").alias("reason"), F.lit(1).cast("long").alias("times")), F.struct(F.lit("repeated").alias("reason"), (F.col("n") - 1).alias("times"))))
    times = times.otherwise(F.array(F.struct(F.lit(None).cast("string").alias("reason"), F.lit(1).cast("long").alias("times"))))
    each = judged.select("value", F.explode(times).alias("t")).select("value", "t.reason", "t.times").unionByName(alone)
    good = F.col("reason").isNull()
    out = each.select("value", F.when(good, _parsed()).alias("r"), F.when(good, F.sha2("value", 256)).alias("version"), "reason", "times")
    return out.withColumn("value", F.when(F.col("reason").isNotNull(), F.substring("value", 1, 4096)))


def write_batch(lines: DataFrame, batch: int, root: str, limits: Limits = Limits()) -> None:
    """One micro-batch: children, headers, dead letters, and last the manifest that makes them count."""
    summed = _summed(lines, limits).persist()  # two branches look at them, and what is observed is counted once
    rows = _judged(summed).persist()
    try:
        good = rows.filter("reason is null").select("version", "r.*").drop("_broken")
        for child in CHILDREN:
            made = good.select("request_id", "ts", "version", F.posexplode(child).alias("seq", "_c"))
            made = made.withColumn("_c", F.col("_c").dropFields("request_id")).select("request_id", "ts", "version", "seq", "_c.*")
            made.write.mode("overwrite").parquet(f"{root}/{child}/batch={batch}")
        header = good.drop(*CHILDREN).withColumn("prompt_hash", F.sha2("prompt_text", 256)).drop("prompt_text")
        header.write.mode("overwrite").parquet(f"{root}/requests/batch={batch}")
        rows.filter("reason is not null").select("reason", "times", "value").write.mode("overwrite").parquet(f"{root}/dead_letters/batch={batch}")
        counts = {r["reason"]: r["n"] for r in rows.groupBy("reason").agg(F.sum("times").alias("n")).collect()}
        written = counts.pop(None, 0)
        told = {"batch": batch, "read": written + sum(counts.values()), "written": written, "dropped": sum(counts.values()), "reasons": counts}
        _put(lines.sparkSession, f"{root}/manifests/{batch}.json", told)
    finally:
        rows.unpersist()
        summed.unpersist()


def _put(spark: SparkSession, path: str, record: dict) -> None:
    storage.put(spark, path, json.dumps(record, sort_keys=True))


def lines_in(spark: SparkSession, folder: str, files_per_trigger: int = 4) -> DataFrame:
    """The lines of a folder as a stream that takes so many files a micro-batch."""
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(folder)


class Progress(StreamingQueryListener):
    """Keeps what each micro-batch of one query has seen, as Spark observed it, in root/progress.

    What a lost executor makes Spark read again is observed again; the manifests have the counts that hold.
    """

    def __init__(self, spark: SparkSession, name: str, root: str):
        self.spark, self.observed, self.root = spark, name, root

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.observed)
        if seen is not None and event.progress.numInputRows:
            told = {"batch": event.progress.batchId, "lines": seen["lines"], "bytes": seen["bytes"] or 0, "rows_per_second": event.progress.processedRowsPerSecond}
            _put(self.spark, f"{self.root}/progress/{event.progress.batchId}.json", told)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def start(lines: DataFrame, root: str, name: str, limits: Limits = Limits(), write=write_batch) -> StreamingQuery:
    """Starts the ingest of a stream of lines (value) into tables below root; goes on where the last run stopped."""
    observed = lines.observe(name, F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("value")).alias("bytes"))
    query = observed.writeStream.queryName(name).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    return query.foreachBatch(lambda df, batch: write(df, batch, root, limits)).start()


def ingested(lines: DataFrame, root: str, name: str, limits: Limits = Limits()) -> None:
    """Runs the ingest until the source has no more, with its progress kept."""
    spark = lines.sparkSession
    listener = Progress(spark, name, root)
    spark.streams.addListener(listener)
    try:
        start(lines, root, name, limits).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(batch, read, written, dropped, reasons): one row for each micro-batch that counts."""
    return spark.read.schema("batch long, read long, written long, dropped long, reasons map<string,long>").json(f"{root}/manifests")


def counters(spark: SparkSession, root: str) -> DataFrame:
    """(read, written, dropped) over all batches."""
    return manifests(spark, root).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("read", "written", "dropped")])


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of requests, of a child table or of dead_letters in batches that count; of each request only its last version."""
    done = manifests(spark, root).select("batch")
    rows = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}").withColumn("batch", F.col("batch").cast("long"))
    rows = rows.join(done, "batch", "left_semi")
    if name == "dead_letters":
        return rows
    headers = rows if name == "requests" else table(spark, root, "requests").select("request_id", "version", "batch")
    if name != "requests":
        return rows.join(headers, ["request_id", "version", "batch"], "left_semi")
    return ledger.latest(headers.withColumn("_last", F.struct("ts", "batch", "version")), ["request_id"], "_last").drop("_last")
