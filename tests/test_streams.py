"""Streams: the commit gate in and out of Spark, recordings, bounded ingest, live rework, canaries."""

from __future__ import annotations

import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyglass import plans
from tallyglass.operators import canaries
from tallyglass.sources import recordings
from tallyglass.streaming import commit, gate, ingest, turns

SF = "/root/testdata/sf0.001"


# the gate by itself, on states that are plain dictionaries


class _State:
    def __init__(self):
        self.value, self.map = None, {}

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    containsKey = lambda self, k: k in self.map
    getValue = lambda self, k: self.map[k]

    def update(self, value):
        self.value = value

    put = update

    def updateValue(self, k, v):
        self.map[k] = v

    def removeKey(self, k):
        del self.map[k]

    def clear(self):
        self.value, self.map = None, {}


class _Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *a):
        return _State()

    getListState = getMapState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class _Times:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentProcessingTimeInMs


class Driver:
    """One request's gate, fed by hand."""

    def __init__(self, **how):
        self.gate, self.handle, self.now = commit.CommitGate(**how), _Handle(), 1_000_000
        self.gate.init(self.handle)
        self.sent = []

    def feed(self, *rows):
        kinds = [dict(zip(("kind", "seq", "idx", "action", "text"), r)) for r in rows]
        for out in self.gate.handleInputRows((7,), iter([pd.DataFrame(kinds, columns=["kind", "seq", "idx", "action", "text"])]), _Times(self.now)):
            self.sent += [tuple(r)[1:] for r in out.itertuples(index=False)]
        return self

    def wait(self, ms):
        self.now += ms
        for at in sorted(t for t in self.handle.timers if t <= self.now):
            if at in self.handle.timers:
                self.handle.timers.remove(at)
                for out in self.gate.handleExpiredTimer((7,), _Times(self.now), _Times(at)):
                    self.sent += [tuple(r)[1:] for r in out.itertuples(index=False)]
        return self

    def said(self):
        assert [n for n, *_ in self.sent] == list(range(len(self.sent)))
        return [(kind, idx, text, note) for _, kind, idx, text, note in self.sent]


ONE, TWO, THREE = "This is the first one. ", "Here comes the second. ", "And that is the third."


def test_a_sentence_waits_for_its_verdict_and_holds_what_follows():
    d = Driver().feed(("chunk", 0, None, None, ONE + TWO))
    assert d.said() == [] and len(d.handle.timers) == 1
    d.feed(("verdict", None, 1, "L0_pass", None))  # early
    assert d.said() == []
    d.feed(("verdict", None, 0, "L1_annotate", "First, they say."))
    assert d.said() == [("annotated", 0, "First, they say.", ""), ("passed", 1, TWO.strip(), "")] and not d.handle.timers
    d.feed(("chunk", 1, None, None, THREE), ("done", 2, None, None, "")).feed(("verdict", None, 2, "L2_repair", None))
    assert d.said()[2:] == [("withheld", 2, "", "")]
    d.feed(("chunk", 3, None, None, "Too late. Really."))
    assert len(d.said()) == 3


def test_the_watchdog_releases_one_sentence_after_the_other():
    d = Driver(watchdog_ms=8000).feed(("chunk", 0, None, None, ONE + TWO), ("done", 1, None, None, ""))
    d.wait(7999)
    assert d.said() == []
    d.wait(1)
    assert d.said() == [("passed", 0, ONE.strip(), "watchdog")] and len(d.handle.timers) == 1
    d.wait(3000).feed(("verdict", None, 1, None, None))  # an engine that failed
    assert d.said()[1:] == [("passed", 1, TWO.strip(), "engine_error")] and not d.handle.timers
    failing = Driver(decide=lambda s: 1 / 0).feed(("chunk", 0, None, None, ONE), ("done", 1, None, None, ""))
    assert failing.said() == [("passed", 0, ONE.strip(), "engine_error")]


def test_a_block_ends_the_answer_and_raw_text_is_not_sent_again():
    d = Driver(buffered=False).feed(("chunk", 0, None, None, ONE + "Here"), ("verdict", None, 0, "L5_block", None), ("chunk", 1, None, None, " more."))
    assert d.said() == [("raw", -1, ONE + "Here", ""), ("terminated", 0, "", "")]
    shown = Driver(buffered=False, decide=lambda s: "L1_annotate").feed(("chunk", 0, None, None, ONE + TWO))
    assert [x[:2] for x in shown.said()] == [("raw", -1), ("annotated", 0), ("annotated", 1)] and all(x[2] == "" for x in shown.said()[1:])


def test_escalation_has_no_way_back_and_sends_only_the_rest():
    d = Driver(buffered=False, decide=lambda s: "L0_pass").feed(("chunk", 0, None, None, ONE + "Here comes")).feed(("escalate", None, None, None, None))
    d.feed(("chunk", 1, None, None, " the second. And so"), ("escalate", None, None, None, None)).feed(("done", 2, None, None, ""))
    assert d.said() == [("raw", -1, ONE + "Here comes", ""), ("passed", 0, "", ""), ("passed", 1, " the second.", ""), ("passed", 2, "And so", "")]


def test_any_cut_into_chunks_and_repeated_deliveries_send_the_same():
    rng = random.Random(3)
    text = "".join(rng.choice([ONE, TWO, "A number of 123456789012 is here. ", "<think>not this. </think>", "It costs Rs. 40,000 or so. ", "x" * 300 + " "]) for _ in range(25))
    decide = gate.by_patterns()
    for _ in range(20):
        cuts = sorted(rng.sample(range(len(text)), 30))
        rows = [("chunk", i, None, None, text[a:b]) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(text)]))] + [("done", 31, None, None, "")]
        plain, sentences = gate.Segmenter(), []  # a run without an end is cut by what has come, so the cuts matter to both
        for *_, chunk in rows[:-1]:
            sentences += plain.push(chunk)
        expected = [(kind, i, t, "") for i, kind, t in gate.released(sentences + plain.finish(), decide)]
        d, at = Driver(decide=decide), 0
        while at < len(rows):
            n = rng.randint(1, 9)
            again = rows[max(0, at - rng.randint(0, 4)) : at]  # delivered before
            d.feed(*rng.sample(again + rows[at : at + n], len(again) + len(rows[at : at + n])))
            at += n
        assert d.said() == expected
        raw = Driver(buffered=False, decide=lambda s: "L0_pass")
        for row in rows:
            raw.feed(row, row)
        assert "".join(t for kind, _, t, _ in raw.said() if kind == "raw") == text


# the gate in Spark


def test_gate_over_triggers_with_timer_and_restart(spark, tmp_path):
    """Chunks over several micro-batches, a timer that fires without input, and a restart in between that repeats nothing."""
    schema = "request_id long, kind string, seq long, idx int, action string, text string"
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put((1, "chunk", 0, None, None, ONE + TWO), (2, "chunk", 0, None, None, ONE), (1, "verdict", None, 0, "L0_pass", None))
    run = lambda: commit.into(commit.gated(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), watchdog_ms=4000), f"{tmp_path}/q")

    def sent():
        try:
            rows = spark.read.schema(f"{commit.SENT}, batch int").parquet(f"{tmp_path}/q/out").collect()
        except Exception:
            return []
        return sorted((r["request_id"], r["n"], r["kind"], r["idx"], r["text"], r["note"]) for r in rows)

    def until(n, query):
        for _ in range(600):
            if query.exception():
                raise query.exception()
            if len(sent()) >= n:
                return
            time.sleep(0.1)
        raise AssertionError(sent())

    query = run()
    until(1, query)
    query.stop()
    assert (1, 0, "passed", 0, ONE.strip(), "") in sent()
    put((1, "chunk", 0, None, None, ONE + TWO), (2, "chunk", 1, None, None, TWO), (2, "verdict", None, 1, "L4_hold", None), (1, "done", 1, None, None, ""), (2, "done", 2, None, None, ""))
    query = run()
    until(4, query)
    time.sleep(1)
    query.stop()
    assert sent() == [(1, 0, "passed", 0, ONE.strip(), ""), (1, 1, "passed", 1, TWO.strip(), "watchdog"), (2, 0, "passed", 0, ONE.strip(), "watchdog"), (2, 1, "withheld", 1, "", "")]


def test_the_streamed_gate_equals_the_batch_gate(spark):
    rows = lambda name: sorted((r["request_id"], r["idx"], r["kind"], r["text"]) for r in plans.QUERIES[name](spark, SF).collect())
    expected = rows("gate_emissions")
    assert expected and rows("gate_releases") == expected


# recordings


def test_windows_of_a_file_hold_every_line_once(tmp_path):
    rng = random.Random(1)
    path = tmp_path / "part-0.txt"
    at, lines = 0.0, [{"_meta": {"stream": "a", "at_ms": 0.0}}]
    for i in range(400):
        at += rng.choice([0, 0, 0.25, 3, 40])
        lines.append({"stream": "a", "at_ms": at, "raw": "x" * rng.choice([1, 50, 9000]) + str(i)})
    path.write_text("\n".join(map(json.dumps, lines)) + "\n")
    read = lambda a, b: [r for batch in recordings._read(recordings.Window(str(path), a, b)) for r in batch.to_pylist()]
    every = read(-1.0, float("inf"))
    assert [r["raw"] for r in every] == [x["raw"] for x in lines[1:]]
    for _ in range(20):
        cuts = [-1.0, *sorted(rng.choice([rng.random() * at, rng.choice(every)["at_ms"]]) for _ in range(6)), at]
        assert [r for a, b in zip(cuts, cuts[1:]) for r in read(a, b)] == every
    with open(path, "ab") as f:
        f.truncate(path.stat().st_size - 1)  # no line end at the end of the file
    assert [r["raw"] for r in read(at - 50, float("inf"))] == [r["raw"] for r in every if r["at_ms"] > at - 50]
    assert recordings._Replay._last_of(str(path)) == at


def test_a_recording_of_one_stream_needs_no_name(spark, tmp_path):
    lines = [{"_meta": {"name": "short", "line_count": 3}}, *({"raw": json.dumps({"choices": [{"delta": {"content": t}}]}), "at_ms": 10.5 * i} for i, t in enumerate(["Yes", ", sir"])), {"raw": "[DONE]", "at_ms": 30.0}]
    (tmp_path / "short.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    rows = recordings.recorded(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r["stream"], r["at_ms"], r["delta"], r["done"]) for r in rows] == [("short", 0.0, "Yes", False), ("short", 10.5, ", sir", False), ("short", 30.0, "", True)]
    assert recordings.recorded(spark, f"{tmp_path}/none").count() == 0


def test_the_gate_asks_its_store_only_for_what_it_needs():
    """A request whose sentences are judged at once has nothing waiting: six messages to the store before, two now."""
    import pandas as pd

    asked = []

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, what):
            return lambda *a: asked.append((self.name, what))

    class Timer:
        def getCurrentProcessingTimeInMs(self):
            return 0

    g = commit.CommitGate(gate.by_patterns())
    g.handle, g.answer, g.waiting, g.verdicts = (State(n) for n in ("handle", "answer", "waiting", "verdicts"))
    rows = [(1, "done", 2, None, None, ""), (1, "chunk", 1, None, None, "One is here. "), (1, "verdict", None, 0, "L0_pass", None)]
    tables = [pd.DataFrame([r], columns=["request_id", "kind", "seq", "idx", "action", "text"]) for r in rows]
    (out,) = g.handleInputRows((1,), iter(tables), Timer())
    assert out[["idx", "kind", "text"]].values.tolist() == [[0, "passed", "One is here."]]
    assert asked == [("answer", "exists"), ("answer", "update")]


# bounded ingest


def _line(i, **more):
    return json.dumps({"request_id": f"r{i}", "ts": float(i), "spend": [{"component": "upstream", "model": "m", "tokens": 3, "inr": 0.5}], "decisions": [{"decision_id": f"d{i}", "action": "L0_pass", "chosen_loss": 1.0}], **more})


def test_ingest_survives_a_crash_and_counts_every_line(spark, tmp_path):
    root, folder = f"{tmp_path}/ledger", tmp_path / "lines"
    folder.mkdir()
    bad = ["{", "[]", "", _line(90, request_id=None), _line(91, ts=None), _line(92, prompt_text="x" * 5000), _line(93, spend=[{"request_id": "r1", "inr": 1.0}]), _line(94, decisions=[{"action": "L7"}])]
    bad += [_line(95, spend=[{"inr": -1.0}]), _line(96, spend=[{"inr": 1.0}] * 6)]
    (folder / "a.txt").write_text("\n".join([*map(_line, range(10)), *bad, _line(3), _line(3), _line(97), _line(97, tenant_id="t"), ""]))
    limits, stopped = ingest.Limits(line_bytes=4096, children=5), []

    def crashing(df, batch, root_, limits_):
        put, ingest._put = ingest._put, lambda *a: 1 / 0  # all but the manifest is written
        try:
            ingest.write_batch(df, batch, root_, limits_)
        except ZeroDivisionError:
            stopped.append(batch)
            raise
        finally:
            ingest._put = put

    with pytest.raises(Exception):  # noqa: B017
        ingest.start(ingest.lines_in(spark, str(folder)), root, "crash", limits, crashing).awaitTermination()
    assert stopped == [0]
    ingest.ingested(ingest.lines_in(spark, str(folder)), root, "first", limits)
    (folder / "b.txt").write_text("\n".join([_line(3, ts=100.0), _line(50), ""]))
    ingest.ingested(ingest.lines_in(spark, str(folder)), root, "second", limits)
    ingest.ingested(ingest.lines_in(spark, str(folder)), root, "third", limits)
    dead = {r["reason"]: r["n"] for r in ingest.table(spark, root, "dead_letters").groupBy("reason").agg(F.sum("times").alias("n")).collect()}
    assert dead == {"malformed": 3, "no id": 1, "no time": 1, "too large": 1, "child of another request": 1, "unknown action": 1, "negative amount": 1, "too many children": 1, "repeated": 2, "conflicting versions": 2}
    assert ingest.counters(spark, root).collect()[0].asDict() == {"read": 26, "written": 12, "dropped": 14}
    got = {r["request_id"]: r["ts"] for r in ingest.table(spark, root, "requests").collect()}
    assert got == {**{f"r{i}": float(i) for i in range(10)}, "r3": 100.0, "r50": 50.0}
    assert {r["request_id"]: r["count"] for r in ingest.table(spark, root, "spend").groupBy("request_id").count().collect()} == dict.fromkeys(got, 1)
    seen = spark.read.json(f"{root}/progress")
    assert seen.agg(F.sum("lines")).first()[0] == 26


def test_what_a_queue_has_no_room_for_is_counted(spark):
    lines = spark.createDataFrame([(_line(i),) for i in range(30)], "value string").coalesce(2)
    got = {r["reason"]: r["n"] for r in ingest.sorted_out(lines, ingest.Limits(queue=10)).groupBy("reason").agg(F.sum("times").alias("n")).collect()}
    assert sum(got.values()) == 30 and got[None] == 10 * lines.rdd.getNumPartitions()
    assert ingest.sorted_out(lines.filter("false")).count() == 0


def test_a_line_is_parsed_once_whatever_looks_at_it(spark):
    """Each look at what the ingest sorts out parsed every line anew, 25 times and more in all."""
    lines = spark.createDataFrame([('{"request_id": "a", "ts": 1}',), ("{",)], "value string")
    parses = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("from_json(")
    summed = ingest._summed(lines, ingest.Limits())
    assert parses(summed) == 1
    kept = spark.createDataFrame(summed.collect(), summed.schema)  # write_batch persists them
    assert parses(ingest._judged(kept)) == 2  # one in each half of a union; rejected lines are not parsed again


# live rework


def test_sessions_are_forgotten(spark, tmp_path):
    """A session's state goes when the watermark is past its window; a turn after that has no edge."""
    turns_ = "session_id long, request_id long, ts long, question string, cost_inr double, regenerate boolean, raised_hold long, resolves_hold long"
    for part in ([(1, 1, 0, "why is that", 1.0, False, 5, None), (2, 2, 10, "a b c", 1.0, False, None, None)], [(1, 3, 60, "why is that", 2.0, False, None, 5), (3, 4, 300, "q", 1.0, False, None, None)],
                 [(4, 5, 600, "q", 1.0, False, None, None)], [(2, 6, 620, "a b c", 1.0, True, None, None), (4, 7, 700, "q", 3.0, True, None, None)]):
        spark.createDataFrame(part, turns_).withColumn("at", F.timestamp_seconds(F.col("ts") + 1000)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = turns.rework_edges(stream).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("memory").queryName("live_edges").start()
    query.awaitTermination()
    got = sorted((r["child"], r["parent"], r["kind"]) for r in spark.table("live_edges").collect())
    assert got == [(3, 1, "human_escalation"), (7, 5, "regenerate")]


# canaries


def test_canaries_against_plain_search(spark, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("abé|.*") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    registry = list({(c, str(sum(map(ord, c)) % 3)) for c in [" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(80)] + ["a", "ab", "abc" * 40]})
    texts = [(i, str(i % 4) if i % 5 else None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(100, "1", None), (101, "1", ""), (102, "2", "abc" * 90)]
    df = spark.createDataFrame(texts, "text_id long, tenant string, text string").repartition(3)
    reg = spark.createDataFrame([*registry, registry[0], ("", "1"), (None, "1")], "canary string, owner string")
    expected = {(i, c, o, t.index(c), t.index(c) + len(c), tenant is not None and tenant != o) for i, tenant, t in texts if t for c, o in registry if c in t}
    got = {tuple(r) for r in canaries.hits(df, reg).collect()}
    assert got == expected and any(x[5] for x in got) and any(not x[5] for x in got)
    monkeypatch.setattr(canaries, "SLICE_BYTES", 300)  # many automata
    assert len(list(canaries._slices(canaries.registered(reg)))) > 3 and {tuple(r) for r in canaries.hits(df, reg).collect()} == expected
    assert canaries.hits(df, reg.filter("false")).count() == 0
    verdict = {r["text_id"]: r for r in canaries.verdicts(canaries.hits(df, reg)).collect()}
    assert set(verdict) == {i for i, *_ in expected} and {r["action"] for r in verdict.values()} == {"L5_block"}
    assert all(r["reason"].endswith("...") or "..." in r["reason"] for r in verdict.values())


def test_registry(spark):
    with pytest.raises(Exception, match="two owners"):
        canaries.registered(spark.createDataFrame([("x", "1"), ("x", "2")], "canary string, owner string")).collect()
    made = canaries.minted(spark, spark.createDataFrame([("acme",), ("b",)], "tenant string"), 3).collect()
    assert len({r["canary"] for r in made}) == 6 and all(r["canary"].startswith(f"IL-CANARY-{r['owner'].upper()}-") for r in made)


def test_holds_that_share_a_state_end_as_each_would(spark, tmp_path, monkeypatch):
    from tallyglass.streaming import live

    monkeypatch.setattr(live, "HOLD_SHARES", 2)
    kinds = "hold_id long, event string, token_ok boolean, minute int, limit int"
    first = [(h, "open", True, 0, 10) for h in range(8)] + [(0, "approve", True, 5, 10), (1, "approve", False, 5, 10), (2, "reject", False, 6, 10), (3, "approve", True, 11, 10), (4, "open", True, 1, 500)]
    second = [(9, "open", True, 60, 70), (0, "reject", True, 61, 10), (4, "approve", True, 62, 500), (10, "approve", True, 63, 70)]
    for n, rows in enumerate((first, second)):
        at = lambda c: F.timestamp_seconds(F.lit(86_400) + F.col(c) * 60)
        df = spark.createDataFrame(rows, kinds).select("hold_id", "event", "token_ok", at("minute").alias("ts"), at("limit").alias("deadline"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = sorted((r["hold_id"], r["state"]) for r in live.finished(live.holds(stream), "append").collect())
    assert got == [(0, "approved"), (1, "expired"), (2, "rejected"), (3, "expired"), (4, "approved"), (5, "expired"), (6, "expired"), (7, "expired"), (10, "approved")]


def test_folds_hand_rows_on_in_pieces(spark, monkeypatch):
    from tallyglass.streaming import live

    seen = []
    monkeypatch.setattr(live, "FOLD_ROWS", 3)
    monkeypatch.setattr(pd, "DataFrame", lambda rows, columns, make=pd.DataFrame: seen.append(len(rows)) or make(rows, columns=columns))

    class Stream:
        def groupBy(self, key):
            return self

        def applyInPandasWithState(self, run, *how):
            self.run = run
            return self

    class Held:
        exists = False

        def update(self, now):
            self.now = now

    held, rows = Held(), pd.concat([pd.Series(range(8), name="event_id").to_frame()[::-1]])
    run = live.folded(Stream(), "g", lambda now, row: ((now[0] + 1,), [(row.event_id, now[0])]), (0,), "g long, event_id long, at int", "n int", ["event_id"]).run
    out = pd.concat(list(run((1,), iter([rows]), held)))
    assert held.now == (8,) and out["event_id"].tolist() == list(range(8)) == out["at"].tolist() and max(seen) <= 3
