"""Rework edges while sessions go on: each turn meets the one before it, which is forgotten when nothing can follow any more."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyglass.operators import sequences
from tallyglass.streaming import commit

_TURN = "request_id long, ts long, question string, raised_hold long"
PAIR = (
    f"session_id long, {_TURN}, cost_inr double, regenerate boolean, resolves_hold long,"
    " prev_request_id long, prev_ts long, prev_question string, prev_raised_hold long"
)


class Previous(StatefulProcessor):
    """Pairs a turn with the previous one of its session; a timer of event time forgets a session window_s after its last turn."""

    def __init__(self, window_s: int):
        self.window_s = window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _TURN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "request_id"])
        held, at = self.last.get() if self.last.exists() else None, 0
        whole = lambda v: None if v is None or v != v else int(v)
        out = []
        for row in table.itertuples(index=False):
            if held is None or row.ts >= held[1]:
                out.append((key[0], row.request_id, row.ts, row.question, whole(row.raised_hold), row.cost_inr, row.regenerate, whole(row.resolves_hold), *(held or (None,) * 4)))
                held, at = (int(row.request_id), int(row.ts), row.question, whole(row.raised_hold)), int(row.at_ms)
        if out:
            # state goes once the watermark says that no turn can come within the window
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.last.update(held)
            self.handle.registerTimer(max(at + self.window_s * 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        made = pd.DataFrame(out, columns=[c.split(" ")[0] for c in PAIR.split(", ")])
        wholes = ["raised_hold", "resolves_hold", "prev_request_id", "prev_ts", "prev_raised_hold"]
        yield made.astype({c: "Int64" for c in wholes})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame(columns=[c.split(" ")[0] for c in PAIR.split(", ")])


def rework_edges(turns: DataFrame, least: float = 0.9, window_s: int = sequences.WINDOW_S) -> DataFrame:
    """Edges from turns (as sequences.rework_edges needs them, ts in seconds, with at, their event time) to the turn before.

    A hold resolved counts if the previous turn raised it. State holds one turn of each session of the last window_s seconds
    behind the watermark; a turn that comes later than its session's last one has no edge.
    """
    commit.with_store(turns.sparkSession)
    kinds = dict(c.split(" ") for c in (PAIR.split(", prev")[0]).split(", "))
    typed = turns.withWatermark("at", "0 seconds").select("at", F.unix_millis("at").alias("at_ms"), *[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    pairs = typed.groupBy("session_id").transformWithStateInPandas(Previous(window_s), PAIR, "append", "eventTime")
    return sequences.edges_of_pairs(pairs, least, window_s)
