"""The commit gate as a stateful stream: one sentence in flight, verdicts under a watchdog, each text released once.

Rows of a request (kind, seq, idx, action, text) come in any number of micro-batches:

* ``chunk``: text of the answer, with a rising seq; ``done`` (with a seq as well) ends it.
* ``verdict``: what is to happen to sentence idx: an action, and for an annotation or a repair the text to send instead. A
  verdict may come before its sentence is complete. With a function ``decide`` no verdicts are needed.
* ``escalate``: from here on text is held until it is judged. There is no way back.

An unbuffered gate sends chunks on as they are and only notes verdicts; of a sentence that was partly sent when the gate was
escalated, only the rest can still be released. A buffered gate holds the first sentence without a verdict and what follows
it. A timer of processing time stands at each held sentence's deadline and releases it with a note, as an engine that fails
does. A block ends the answer.

Every row sent has the number of its request's emission, and chunks at or below the last seq are ignored; with state and
sink from one checkpoint, a restart sends nothing twice. Requests that nothing happens to for a while are forgotten.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tallyglass.streaming import gate

#: Fixed value: milliseconds after which a sentence without a verdict is released.
WATCHDOG_MS = 8000
#: Milliseconds after its last change at which a request's state is forgotten.
FORGET_MS = 3_600_000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = "request_id long, kind string, seq long, idx int, action string, text string"
SENT = "request_id long, n int, kind string, idx int, text string, note string"
_REPLACED = {"L1_annotate": "annotated", "L2_repair": "repaired", "L3_reroute": "repaired"}

Decide = Callable[[str], str]


class Answer:
    """What a request's value state holds, as plain attributes."""

    FIELDS = ("buffer", "carry", "reasoning", "last", "sentences", "sent", "buffered", "gone", "closed", "ended")
    STATE = "buffer string, carry string, reasoning boolean, last long, sentences int, sent int, buffered boolean, gone int, closed boolean, ended boolean"

    def __init__(self, held: tuple | None, buffered: bool):
        values = held or ("", "", False, -1, 0, 0, buffered, 0, False, False)
        for name, value in zip(self.FIELDS, values):
            setattr(self, name, value)

    def state(self) -> tuple:
        return tuple(getattr(self, name) for name in self.FIELDS)


_KINDS = {"escalate": 0, "chunk": 1, "done": 1, "verdict": 2}


def _turn(row) -> tuple:
    """Where a row stands among those of its request: by seq (rows without one first), kind and idx, what is missing last."""
    return (-1 if pd.isna(row.seq) else row.seq, _KINDS.get(row.kind, 3), float("inf") if pd.isna(row.idx) else row.idx)


class CommitGate(StatefulProcessor):
    def __init__(self, decide: Decide | None = None, repair: Callable[[str], str | None] | None = None, buffered: bool = True, watchdog_ms: int = WATCHDOG_MS, forget_ms: int = FORGET_MS):
        self.decide, self.repair, self.buffered, self.watchdog_ms, self.forget_ms = decide, repair, buffered, watchdog_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answer = handle.getValueState("answer", Answer.STATE, self.forget_ms)
        self.waiting = handle.getListState("waiting", "idx int, sentence string, skip int, shown boolean, due long", self.forget_ms)
        self.verdicts = handle.getMapState("verdicts", "idx int", "action string, text string", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # plain tuples: a table of a few rows for each request costs more than the gate itself
        told = [row for table in rows for row in table.itertuples(index=False)]
        yield from self._run(key, sorted(told, key=_turn), timerValues.getCurrentProcessingTimeInMs(), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._run(key, (), timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def _run(self, key, rows, now: int, expired: int | None) -> Iterator[pd.DataFrame]:
        # every look at state is a message to the store and back
        begun = self.answer.exists()
        a = Answer(self.answer.get() if begun else None, self.buffered)
        waiting = [tuple(x) for x in self.waiting.get()] if begun and self.waiting.exists() else []
        held = bool(waiting)
        out: list[tuple] = []

        def send(kind: str, idx: int, text: str, note: str = "") -> None:
            out.append((key[0], a.sent, kind, idx, text, note))
            a.sent += 1

        for row in rows:
            if a.ended:
                break
            if row.kind == "escalate":
                if not a.buffered:
                    a.buffered, a.gone = True, len(a.buffer.lstrip())
            elif row.kind == "verdict":
                if self.decide is None:  # with a function they are never looked at
                    self.verdicts.updateValue((int(row.idx),), (row.action, row.text))
            elif row.seq > a.last:
                a.last = int(row.seq)
                waiting += self._sentences(a, row, send)
            self._settle(a, waiting, now, None, send)
        self._settle(a, waiting, now, expired, send)
        if a.closed and not waiting:
            a.ended = True
        if a.ended:
            waiting = []
            if self.decide is None:
                self.verdicts.clear()
        if waiting:
            self.waiting.put(waiting)
        elif held:
            self.waiting.clear()
        self.answer.update(a.state())
        if out:
            yield pd.DataFrame(out, columns=["request_id", "n", "kind", "idx", "text", "note"])

    @staticmethod
    def _sentences(a: Answer, row, send) -> list[tuple]:
        """Sentences that a chunk completes; of the first after an escalation, how many characters have gone out."""
        s = gate.Segmenter(a.buffer, a.carry, a.reasoning)
        text = row.text or ""
        if not a.buffered and text:
            send("raw", -1, text)
        found = s.push(text)
        if row.kind == "done":
            found += s.finish()
            a.closed = True
        a.buffer, a.carry, a.reasoning = s.buffer, s.carry, s.reasoning
        made = []
        for sentence in found:
            skip = min(a.gone, len(sentence))
            a.gone = max(0, a.gone - skip - 1) if a.gone > skip else 0  # a space lay between two sentences
            made.append((a.sentences, sentence, skip, not a.buffered, 0))
            a.sentences += 1
        return made

    def _settle(self, a: Answer, waiting: list[tuple], now: int, expired: int | None, send) -> None:
        """Applies verdicts to the sentences at the front; the first without one gets a deadline and stops the rest."""
        while waiting and not a.ended:
            idx, sentence, skip, shown, due = waiting[0]
            verdict, note = self._verdict(idx, sentence)
            if verdict is None and expired is not None and due and due <= expired:
                verdict, note = ("L0_pass", None), "watchdog"
            if verdict is None:
                if not due:
                    waiting[0] = (idx, sentence, skip, shown, now + self.watchdog_ms)
                    self.handle.registerTimer(now + self.watchdog_ms)
                return
            if due and due != expired:
                self.handle.deleteTimer(due)
            waiting.pop(0)
            self._apply(a, idx, sentence, skip, shown, verdict, note, send)

    def _verdict(self, idx: int, sentence: str) -> tuple[tuple | None, str]:
        """(action, text) with the text to send, and a note; None while there is none."""
        if self.decide is not None:
            try:
                (_, kind, text), *_ = gate.released([sentence], self.decide, self.repair)
            except Exception:
                return ("L0_pass", None), "engine_error"
            action = {"passed": "L0_pass", "annotated": "L1_annotate", "repaired": "L2_repair", "withheld": "L4_hold", "terminated": "L5_block"}[kind]
            return (action, text if kind == "repaired" else None), ""
        if not self.verdicts.containsKey((idx,)):
            return None, ""
        action, text = self.verdicts.getValue((idx,))
        self.verdicts.removeKey((idx,))
        return ((action, text), "") if action else (("L0_pass", None), "engine_error")

    @staticmethod
    def _apply(a: Answer, idx: int, sentence: str, skip: int, shown: bool, verdict: tuple, note: str, send) -> None:
        action, text = verdict
        if action == "L5_block":
            a.ended = True
            send("terminated", idx, "", note)
        elif action in ("L2_repair", "L3_reroute") and text:
            send("repaired", idx, text, note)  # in full: a replacement is told as one
        elif action in ("L2_repair", "L3_reroute", "L4_hold"):
            send("withheld", idx, "", note)
        else:
            kind = _REPLACED.get(action, "passed")
            # what has gone out raw isn't sent again; an annotation then rides on its own
            send(kind, idx, (text or "") if shown else text or sentence[skip:], note)


def with_store(spark: SparkSession) -> None:
    """Timers and lists need the store that keeps state on disk."""
    spark.conf.set(STORE, ROCKS)


def gated(rows: DataFrame, decide: Decide | None = None, repair: Callable[[str], str | None] | None = None, buffered: bool = True, watchdog_ms: int = WATCHDOG_MS) -> DataFrame:
    """(request_id, n, kind, idx, text, note) of a stream of ROWS; n numbers the emissions of a request without gaps."""
    with_store(rows.sparkSession)
    held = rows.select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in ROWS.split(", ")])
    return held.groupBy("request_id").transformWithStateInPandas(CommitGate(decide, repair, buffered, watchdog_ms), SENT, "append", "processingTime")


def chunk_rows(replay: DataFrame) -> DataFrame:
    """Rows for the gate from a replayed recording whose streams are named by request ids."""
    return replay.select(
        F.col("stream").cast("long").alias("request_id"), F.when(F.col("done"), "done").otherwise("chunk").alias("kind"), F.col("place").alias("seq"),
        F.lit(None).cast("int").alias("idx"), F.lit(None).cast("string").alias("action"), F.col("delta").alias("text"),
    )


def into(stream: DataFrame, folder: str, every: str = "0 seconds") -> StreamingQuery:
    """Starts a query that writes each micro-batch to a folder of its own below folder/out, which a repeat overwrites."""

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    return stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(processingTime=every).foreachBatch(keep).start()


def drained(query: StreamingQuery, source_end: dict, timeout_s: float = 600.0, settled: Callable[[], bool] | None = None) -> list[dict]:
    """Waits until a query has gone past the end of its source (and until settled() holds), and stops it; its progress.

    A query with timers runs a micro-batch at every trigger, so that there is no state of rest to wait for.
    """
    seen: dict[int, dict] = {}
    until = time.time() + timeout_s
    try:
        while time.time() < until:
            if query.exception():
                raise query.exception()
            for p in map(json.loads, (x.json for x in query.recentProgress)):
                seen[p["batchId"]] = p
            if any(p["sources"][0]["endOffset"] == source_end for p in seen.values()) and (settled is None or settled()):
                return [seen[k] for k in sorted(seen)]
            time.sleep(0.1)
        raise TimeoutError("the stream didn't reach its end")
    finally:
        query.stop()
