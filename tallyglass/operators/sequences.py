"""Ordered operators: rework, loops, taint, strata, splits, tool calls, replay, breakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass import policy, schemas, storage
from tallyglass.functions import folds, text
from tallyglass.operators import ledger

#: How sure each kind of rework is, and the window of a retry in seconds.
CONFIDENCE = {"human_escalation": 1.0, "regenerate": 0.95, "retry": 0.9}
FLOOR, WINDOW_S = 0.5, 120


def rework_edges(turns: DataFrame, least: float = 0.9, window_s: int = WINDOW_S, review_inr: float = policy.POLICY["review_cost_inr"]) -> DataFrame:
    """Edges from a turn to the one that caused it: a resolved hold first, then a regeneration, then a similar question soon after.

    Needs session_id, request_id, ts, question, cost_inr, regenerate, raised_hold and resolves_hold (null if none).
    """
    order = Window.partitionBy("session_id").orderBy("ts", "request_id")
    last = turns.withColumn("_prev", F.lag(F.struct("request_id", "ts", "question")).over(order))
    raised = turns.filter("raised_hold is not null").groupBy("session_id", F.col("raised_hold").alias("resolves_hold")).agg(F.max_by("request_id", F.struct("ts", "request_id")).alias("_raiser"))
    both = last.join(raised, ["session_id", "resolves_hold"], "left")
    return _edges(both, least, window_s, review_inr)


def edges_of_pairs(pairs: DataFrame, least: float = 0.9, window_s: int = WINDOW_S, review_inr: float = policy.POLICY["review_cost_inr"]) -> DataFrame:
    """rework_edges() where each turn comes with the one before it (prev_request_id, prev_ts, prev_question, prev_raised_hold)."""
    previous = F.when(F.col("prev_request_id").isNotNull(), F.struct(F.col("prev_request_id").alias("request_id"), F.col("prev_ts").alias("ts"), F.col("prev_question").alias("question")))
    raiser = F.when(F.col("prev_raised_hold") == F.col("resolves_hold"), F.col("prev_request_id"))
    return _edges(pairs.withColumns({"_prev": previous, "_raiser": raiser}), least, window_s, review_inr)


def _edges(both: DataFrame, least: float, window_s: int, review_inr: float) -> DataFrame:
    resolved = F.col("_raiser").isNotNull() & (F.col("_raiser") != F.col("request_id"))
    gap = F.col("ts") - F.col("_prev.ts")
    score = F.round(text.session_similarity(F.col("question"), F.col("_prev.question")), 9)
    again = (gap >= 0) & (gap <= window_s) & (score >= least)
    reach = F.least(F.lit(1.0), (score - least) / max(1e-9, 1 - least))
    kind = F.when(resolved, "human_escalation").when(F.col("_prev").isNull(), None).when(F.col("regenerate"), "regenerate").when(again, "retry")
    sure = F.when(F.col("kind") == "retry", FLOOR + (CONFIDENCE["retry"] - FLOOR) * reach).when(F.col("kind") == "regenerate", CONFIDENCE["regenerate"]).otherwise(1.0)
    charged = F.when(F.col("kind") == "human_escalation", F.col("cost_inr") + review_inr).otherwise(F.col("cost_inr") * F.col("confidence"))
    found = both.withColumn("kind", kind).filter("kind is not null").withColumn("confidence", sure)
    parent = F.when(F.col("kind") == "human_escalation", F.col("_raiser")).otherwise(F.col("_prev.request_id"))
    return found.select("session_id", F.col("request_id").alias("child"), parent.alias("parent"), "kind", F.round("confidence", 6).alias("confidence"), F.round(charged, 4).alias("inr_charged"))


def loop_breaks(calls: DataFrame, key: str, repeats: int = 3) -> DataFrame:
    """Where each case is cut: its first call that is the third of its kind, and the calls from there on."""
    nth = F.row_number().over(Window.partitionBy(key, "digest").orderBy("idx"))
    cut = calls.withColumn("_n", nth).filter(F.col("_n") == repeats).groupBy(key).agg(F.min("idx").alias("cut_at"))
    sizes = calls.groupBy(key).agg(F.count("*").alias("calls"), F.max("idx").alias("_last"))
    return sizes.join(cut, key, "left").select(key, "calls", "cut_at", F.coalesce(F.col("_last") - F.col("cut_at"), F.lit(0)).alias("remaining"))


def cumulative_taint(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    worst = F.max(schemas.rank("provenance", schemas.PROVENANCE)).over(upto)
    return rows.withColumn("taint", schemas.at_rank(worst, schemas.PROVENANCE))


def stratified_prefix(rows: DataFrame, mode: str, level: str, order: str, n: int) -> DataFrame:
    """The first n rows of a round robin over cells; in each round a mode takes another level, rotated by its place."""
    number = lambda c: F.dense_rank().over(Window.orderBy(c)) - 1
    modes = rows.select(mode).distinct().withColumn("_m", number(mode))
    levels = rows.select(level).distinct().withColumn("_l", number(level))
    n_levels = levels.count()
    offset = F.row_number().over(Window.partitionBy(mode, level).orderBy(order)) - 1
    placed = rows.withColumn("_o", offset).filter(F.col("_o") < n).join(F.broadcast(modes), mode).join(F.broadcast(levels), level)
    turn = F.pmod(F.col("_l") - F.col("_m"), F.lit(n_levels))
    first = placed.orderBy("_o", turn, "_m").limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy("_o", turn, "_m")) - 1).drop("_o", "_m", "_l")


def domain_split(docs: DataFrame, share: float = 0.6, pinned: Column | None = None) -> DataFrame:
    """calibration or evaluation for each document: by hash order within its domain, both sides non-empty from two on."""
    pinned = F.lit(False) if pinned is None else pinned
    free = docs.filter(~pinned).withColumn("_b", F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16))
    own = Window.partitionBy("domain")
    cut = F.bround(F.count("*").over(own) * share)
    cut = F.when(F.count("*").over(own) >= 2, F.greatest(F.lit(1), F.least(F.count("*").over(own) - 1, cut))).otherwise(cut)
    side = F.when(F.row_number().over(own.orderBy("_b", "doc_id")) <= cut, "calibration").otherwise("evaluation")
    return free.select("doc_id", "domain", side.alias("split")).unionByName(docs.filter(pinned).select("doc_id", "domain", F.lit("evaluation").alias("split")))


def assembled_calls(deltas: DataFrame) -> DataFrame:
    """One row for each tool call of a streamed request: arguments joined in order, the last name wins, nameless is incomplete."""
    named = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name", "args"))), lambda d: d["name"]), lambda x: x.isNotNull())
    args = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name", "args"))), lambda d: F.coalesce(d["args"], F.lit(""))), "")
    out = deltas.groupBy("request_id", "call").agg(named.alias("_n"), args.alias("arguments"))
    return out.select("request_id", "call", F.try_element_at("_n", F.lit(-1)).alias("name"), "arguments", (F.size("_n") > 0).alias("complete"))


def replay(events: DataFrame, key: str, cursor: Column, keep: int = 200) -> DataFrame:
    """What a viewer gets: of the last ``keep`` events of a stream, those after its cursor."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
    return events.withColumn("_n", newest).filter((F.col("_n") <= keep) & (F.col("seq") > cursor)).drop("_n")


def new_events(events: DataFrame, key: str, arrival: str) -> DataFrame:
    """Events whose sequence number is above all that arrived before on the stream."""
    before = F.max("seq").over(Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("seq") > F.col("_b"))).drop("_b")


def breaker_trips(failures: DataFrame, key: str, seconds: int = 10, count: int = 5) -> DataFrame:
    """Failures that complete ``count`` of them within ``seconds``; ts is in seconds."""
    recent = Window.partitionBy(key).orderBy("ts").rangeBetween(-seconds, 0)
    return failures.withColumn("recent", F.count("*").over(recent)).withColumn("trips", F.col("recent") >= count)


#: Where each state begins by p95 in ms, the rows looked back on, and how far under before recovery.
LADDER, LOOK_BACK, ENOUGH, RECOVERY = ((1, 60.0), (2, 90.0), (3, 120.0), (4, 200.0)), 200, 20, 0.75


def step_governor(state: int, recent: list[float], breaker_open: bool = False) -> int:
    """The next state: up as far as the p95 asks, down one step at a time and only well inside the threshold."""
    if breaker_open:
        return 2
    if len(recent) < ENOUGH:
        return state
    ordered = sorted(recent)
    return _governed(state, ordered[min(len(ordered) - 1, round(0.95 * (len(ordered) - 1)))])


def _governed(state: int, p95: float | None) -> int:
    """The next state by the p95 of the rows looked back on; with too few of them there is none."""
    if p95 is None or p95 != p95:
        return state
    target = max((s for s, t in LADDER if p95 >= t), default=0)
    if target > state:
        return target
    return state - 1 if target < state and p95 <= dict(LADDER)[state] * RECOVERY else state


def governor_trace(rows: DataFrame, key: str) -> DataFrame:
    """State after every overhead of a deployment.

    The path depends on all rows before; as there are five states, blocks of rows become maps of states that are composed, so
    one deployment may hold all rows.
    """
    placed = folds.placed(rows.select(key, "request_id", "ts", "overhead_ms"), [key], ["ts", "request_id"])
    enough = F.count("overhead_ms").over(folds.back(LOOK_BACK)) >= ENOUGH
    seen = folds.looking_back(placed, [key], LOOK_BACK, F.when(enough, ledger.p95_of_last(LOOK_BACK)).alias("p95"))
    traced = folds.run_machine(storage.stage(seen), [key], len(schemas.GOVERNOR), _governed, "p95", "_state")
    return traced.select(key, "request_id", schemas.at_rank(F.col("_state"), schemas.GOVERNOR).alias("state"))

