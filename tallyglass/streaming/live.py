"""Structured Streaming over ledger facts: windows, stateful folds, and idempotent sinks.

Sources carry timestamps without a zone; watermarks need one, so event time is cast on the way in (sessions run in UTC).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyglass import schemas, storage
from tallyglass.operators import ledger, sequences
from tallyglass.streaming import gate

RETRY, SLA = "2 minutes", "15 minutes"
#: States that all holds are dealt to.
HOLD_SHARES = 256
#: Rows that a fold makes before it hands them on.
FOLD_ROWS = 20_000


def checkpoint_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors see."""
    return f"{storage.shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str, per_trigger: int = 1) -> DataFrame:
    """The events table as a stream, with event time and the counter of its properties."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.parquet").parquet(_folder(sf_dir, "events"))
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def _folder(sf_dir: str, name: str) -> str:
    """A file stream reads a folder or a pattern; a table may be one file."""
    return f"{sf_dir}/{name}*.parquet"


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Everything the source has, run to its end, as a batch result in files that executors share."""
    spark, folder = stream.sparkSession, checkpoint_folder(stream.sparkSession)
    out = f"{folder}/out"

    def keep(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    fields = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    try:
        return spark.read.schema(fields).parquet(f"{out}/batch=*")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):  # no batch had rows
            return spark.createDataFrame([], fields)
        raise


def latest_of(result: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of update mode: the last batch's row of each key."""
    return ledger.latest(result, keys, "_batch").drop("_batch")


def windowed(stream: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Counts and values by event-time window and kind; late rows count up to the watermark."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", RETRY).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "k")


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    return stream.withWatermark("ts", RETRY).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    return stream.withWatermark("ts", SLA).dropDuplicates([*keys, "ts"])


def folded(stream: DataFrame, key: str, step: Callable, start: tuple, out: str, state: str, order: list[str]) -> DataFrame:
    """A fold per key: step(state, row) returns the next state and rows. Rows of a batch are taken in order.

    A batch's rows of a key are in memory together, so the stream should have no columns that the step doesn't need.
    """

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now, made = (tuple(held.get) if held.exists else start), []
        names = [c.strip().split(" ")[0] for c in out.split(",")]
        for row in pd.concat(list(pdfs)).sort_values(order).itertuples(index=False):
            now, rows = step(now, row)
            made += [(*k, *r) for r in rows]
            if len(made) >= FOLD_ROWS:
                yield pd.DataFrame(made, columns=names)
                made = []
        held.update(now)
        yield pd.DataFrame(made, columns=names)

    return stream.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def governor(stream: DataFrame) -> DataFrame:
    """The governor's state changes, by tenant; its look-back is kept in the state."""

    def step(now: tuple, row) -> tuple[tuple, list]:
        state, recent = now[0], [*now[1], row.value][-sequences.LOOK_BACK :]
        new = sequences.step_governor(state, recent)
        return (new, recent), [(row.event_id, schemas.GOVERNOR[new])] if new != state else []

    return folded(stream.select((F.col("user_id") % 5).alias("tenant"), "event_id", "value"), "tenant", step, (0, []), "tenant long, event_id long, state string", "state int, recent array<double>", ["event_id"])


def step_breaker(now: tuple, at: float, failed: bool, failures: int = 5, window_s: float = 10.0, open_s: float = 30.0) -> tuple[tuple, str, bool]:
    """The next state (times of failures, when it opened, whether the probe is out), the state met, and whether the call went through.

    So many failures within the window open it; after a while one call goes through, whose success closes it again and
    whose failure opens it anew.
    """
    recent, opened, probing = list(now[0]), now[1], now[2]
    met = "closed" if opened is None else "half_open" if at - opened >= open_s else "open"
    through = met == "closed" or (met == "half_open" and not probing)
    if not through:
        return (recent, opened, probing), met, False
    if not failed:
        return ([], None, False), met, True
    recent = [t for t in (*recent, at) if at - t <= window_s]
    if met == "half_open" or len(recent) >= failures:
        return ([], at, False), met, True
    return (recent, opened, probing), met, True


def breaker(stream: DataFrame) -> DataFrame:
    """A circuit breaker for each service: what state a call met, and whether it went through. Needs service, event_id, at, failed."""

    def step(now: tuple, row) -> tuple[tuple, list]:
        new, met, through = step_breaker((now[0], None if now[1] < 0 else now[1], now[2]), float(row.at), bool(row.failed))
        return (new[0], -1.0 if new[1] is None else new[1], new[2]), [(row.event_id, met, through)]

    return folded(stream, "service", step, ([], -1.0, False), "service long, event_id long, state string, admitted boolean", "failures array<double>, opened double, probing boolean", ["event_id"])


def loop_breaker(stream: DataFrame, repeats: int = 3) -> DataFrame:
    """The call of a session that is the third of its kind."""

    def step(now: tuple, row) -> tuple[tuple, list]:
        counts = dict(now[0])
        counts[row.event_type] = counts.get(row.event_type, 0) + 1
        return (counts,), [(row.event_id, row.event_type)] if counts[row.event_type] == repeats else []

    return folded(stream, "user_id", step, ({},), "user_id long, event_id long, digest string", "counts map<string,int>", ["event_id"])


def evalue_monitor(stream: DataFrame, mu0: float = 0.05, warmup: int = 10, safety: float = 0.5) -> DataFrame:
    """The betting martingale as a stream, by tenant: its logarithm after every observation."""
    import math

    def step(now: tuple, row) -> tuple[tuple, list]:
        n, total, squares, log_e, most = now
        x, bet = float(row.error), 0.0
        if n >= warmup and (excess := total / n - mu0) > 0:
            bet = min(excess / (max(1e-12, squares / n - (total / n) ** 2) + excess**2), safety / mu0)
        log_e += math.log(1 + bet * (x - mu0))
        most = max(most, log_e)
        return (n + 1, total + x, squares + x * x, log_e, most), [(row.event_id, log_e, most >= math.log(20))]

    return folded(stream.select((F.col("user_id") % 5).alias("tenant"), "event_id", F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("error")), "tenant", step, (0, 0.0, 0.0, 0.0, 0.0), "tenant long, event_id long, log_e double, alerted boolean", "n long, total double, squares double, log_e double, most double", ["event_id"])


def holds(stream: DataFrame) -> DataFrame:
    """Hold state by fold: pending until the first resolution that counts; what nobody resolves expires with the watermark.

    Needs hold_id, event, token_ok, deadline and ts. Holds are dealt into shares, one state each, since a state of its own for
    every hold costs far more than its fold; a timer in event time stands at the first deadline of a share.
    """

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        known = {i: (state, at) for i, state, at in zip(*held.get)} if held.exists else {}
        now, made = held.getCurrentWatermarkMs(), []
        if not held.hasTimedOut:
            for row in pd.concat(list(pdfs)).sort_values("ts", kind="stable").itertuples(index=False):
                state = known.get(row.hold_id, ("pending", -1))[0]
                if state == "pending":
                    if row.event == "reject":
                        state = "rejected"
                    elif row.event == "approve" and row.token_ok and row.ts <= row.deadline:
                        state = "approved"
                    if state != "pending":
                        made.append((row.hold_id, state))
                known[row.hold_id] = (state, -1 if pd.isna(row.deadline) else int(row.deadline.timestamp() * 1000))
        due = [i for i, (state, at) in known.items() if state == "pending" and 0 <= at <= now]
        for i in due:
            del known[i]
            made.append((i, "expired"))
        held.update(([*known], [state for state, _ in known.values()], [at for _, at in known.values()]))
        if waiting := [at for state, at in known.values() if state == "pending" and at >= 0]:
            held.setTimeoutTimestamp(min(waiting))
        yield pd.DataFrame(made, columns=["hold_id", "state"])

    shared = stream.withWatermark("ts", "0 seconds").withColumn("_share", F.pmod(F.xxhash64("hold_id"), F.lit(HOLD_SHARES)))
    return shared.groupBy("_share").applyInPandasWithState(run, "hold_id long, state string", "ids array<bigint>, states array<string>, deadlines array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def segments(stream: DataFrame) -> DataFrame:
    """Sentences of streamed chunks (request_id, seq, delta, done): buffer, carry and flag are the state of a request."""

    def step(now: tuple, row) -> tuple[tuple, list]:
        s = gate.Segmenter(*now[:3])
        done = s.push(row.delta or "") + (s.finish() if row.done else [])
        return (s.buffer, s.carry, s.reasoning, now[3] + len(done)), [(now[3] + i, x) for i, x in enumerate(done)]

    return folded(stream, "request_id", step, ("", "", False, 0), "request_id long, idx long, sentence string", "buffer string, carry string, reasoning boolean, idx long", ["seq"])


def shape(df: DataFrame, table: str) -> DataFrame:
    """A sink's rows: the table's columns and types; what is missing is null."""
    names = {c.split(" ")[0] for c in schemas.TABLES[table].split(", ")}
    return df.select(*[c for c in df.columns if c in names])


def sink_requests(stream: DataFrame, root: str, name: str = "ledger"):
    """Request batches (a header with arrays of children) into the ledger's tables, safe to repeat.

    Children go first and the header last, each into a folder of the batch that a repeat overwrites; readers take children
    of headers that are there (see committed). Rows whose header has no id go to a quarantine folder and stop nothing.
    Prompts are kept as digests.
    """

    def write(df: DataFrame, batch: int) -> None:
        df = df.persist()
        good = df.filter("request_id is not null")
        for child in ("signals", "decisions", "spend"):
            if child in df.columns:
                rows = good.select("request_id", F.explode(child).alias("_c")).select("request_id", "_c.*")
                rows.write.mode("overwrite").parquet(f"{root}/{child}/batch={batch}")
        header = good.drop("signals", "decisions", "spend")
        if "prompt_text" in header.columns:
            header = header.withColumn("prompt_hash", F.sha2("prompt_text", 256)).drop("prompt_text")
        header.write.mode("overwrite").parquet(f"{root}/requests/batch={batch}")
        df.filter("request_id is null").select(F.to_json(F.struct("*")).alias("row")).write.mode("overwrite").parquet(f"{root}/quarantine/batch={batch}")
        df.unpersist()

    observed = stream.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("request_id").isNull()).alias("dropped"))
    return observed.writeStream.queryName(name).option("checkpointLocation", f"{root}/_state").trigger(availableNow=True).foreachBatch(write).start()


def committed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A child table's rows whose header is there, or the last version of each header."""
    headers = ledger.latest(spark.read.parquet(f"{root}/requests"), ["request_id"], "batch")
    if table == "requests":
        return headers.drop("batch")
    return spark.read.parquet(f"{root}/{table}").join(headers.select("request_id", "batch"), ["request_id", "batch"], "left_semi").drop("batch")
