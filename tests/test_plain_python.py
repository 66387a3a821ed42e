"""Queries that SQL can't state, against plain Python over the same rows."""

from __future__ import annotations

from collections import defaultdict
from datetime import timedelta

import pytest

from tallyglass import plans, views
from tallyglass.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    from pyspark.sql import functions as F

    e = views.table(spark, SF, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return sorted(e.collect(), key=lambda r: r["event_id"])


def rows(spark, name):
    return [tuple(r) for r in plans.QUERIES[name](spark, SF).collect()]


def test_breaker_opens_probes_and_closes():
    now, seen = ([], None, False), []
    calls = [(t, True) for t in range(0, 5)] + [(10, False), (33, True), (34, True), (40, False), (64, False), (65, True), (70, True), (76, True), (79, True), (80, True), (80.5, True), (80.8, True), (81, False)]
    for at, failed in calls:
        now, met, through = live.step_breaker(now, float(at), failed)
        seen.append((met, through))
    assert seen[:5] == [("closed", True)] * 5 and seen[5] == ("open", False)
    assert seen[6] == ("open", False) and seen[7] == ("half_open", True) and seen[8] == ("open", False)  # the probe failed
    assert seen[9] == ("half_open", True) and seen[10:17] == [("closed", True)] * 7  # the probe closed it; old failures ran out
    assert seen[17] == ("open", False)


def test_stream_breaker(spark, events):
    state, expected = defaultdict(lambda: ([], None, False)), set()
    for r in events:
        s = r["user_id"] % 5
        state[s], met, through = live.step_breaker(state[s], r["event_id"] * 0.2, r["event_type"] == "error" or r["event_id"] % 300 < 40)
        expected.add((s, r["event_id"], met, through))
    got = rows(spark, "stream_breaker")
    assert len(got) == len(events) and set(got) == expected and {"open", "half_open", "closed"} == {g[2] for g in got}


def test_stream_sessions(spark, events):
    last = max(r["ts"] for r in events)
    by_user, expected = defaultdict(list), set()
    for r in events:
        by_user[r["user_id"]].append(r["ts"])
    for user, times in by_user.items():
        times.sort()
        start, n = 0, len(times)
        for i in range(1, n + 1):
            if i == n or times[i] - times[i - 1] >= timedelta(minutes=30):
                end = times[i - 1] + timedelta(minutes=30)
                if end <= last - timedelta(minutes=2):
                    expected.add((times[start], end, user, i - start))
                start = i
    got = {(a.replace(tzinfo=None), b.replace(tzinfo=None), u, n) for a, b, u, n in rows(spark, "stream_sessions")}
    assert got == expected


def test_bootstrap_interval_lies_around_the_mean(spark, events):
    """2,000 resamples would give the normal interval; 200 come near it."""
    values = [r["value"] for r in events]
    mean = sum(values) / len(values)
    error = (sum((v - mean) ** 2 for v in values) / len(values) / len(values)) ** 0.5
    row = plans.QUERIES["bootstrap_ci"](spark, SF).collect()[0].asDict()
    low, high = (next(v for k, v in row.items() if w in k) for w in ("low", "high"))
    assert low < mean < high and 2.5 * error < high - low < 5.5 * error
    assert row == plans.QUERIES["bootstrap_ci"](spark, SF).collect()[0].asDict()


def test_calibrated_probabilities_rank_and_calibrate(spark):
    """Fitted probabilities: in [0, 1], on the whole as frequent as what they predict, and better ranked than by chance."""
    for name in ("calibrator_fit", "oof_scores"):
        got = [r.asDict() for r in plans.QUERIES[name](spark, SF).collect()]
        truth = {r["doc_id"]: r["y2"] for r in views.scored(spark, SF).select("doc_id", "y2").collect()}
        y, p = [truth[r["doc_id"]] for r in got], [next(v for k, v in r.items() if isinstance(v, float)) for r in got]
        assert all(0 <= x <= 1 for x in p) and abs(sum(p) / len(p) - sum(y) / len(y)) < 0.12
        pairs = [(a, b) for a, u in zip(p, y) for b, v in zip(p, y) if u > v]
        assert sum((a > b) + (a == b) / 2 for a, b in pairs) > 0.6 * len(pairs)


def test_hash_embeddings_are_unit_vectors_of_words(spark):
    docs = {r["doc_id"]: r["text"] for r in views.table(spark, SF, "documents").collect()}
    got = {i: v for i, v in rows(spark, "hash_embed")}
    assert set(got) == set(docs)
    for i, v in got.items():
        assert len(v) == 256 and sum(x * x for x in v) == pytest.approx(1, abs=1e-5) or not any(v)
    same = defaultdict(set)
    for i, t in docs.items():
        same[" ".join(t.lower().split())].add(tuple(got[i]))
    assert all(len(v) == 1 for v in same.values())


def test_sentences_of_a_long_text_take_time_in_proportion():
    import time

    from tallyglass.functions.udfs import split_sentences

    began = time.process_time()
    done, rest = split_sentences("One two three vs. four at no. 3 costs 2.5. So Mr. B\n. said it. " * 12000)
    assert len(done) == 24000 and rest == "" and set(done) == {"One two three vs. four at no. 3 costs 2.5.", "So Mr. B\n. said it."}
    assert time.process_time() - began < 10


def test_vectors_of_a_batch_are_one_block_of_floats():
    """Texts and vectors of a batch were objects of Python all at once."""
    import numpy as np
    import pyarrow as pa

    from tallyglass.functions import udfs

    texts = ["one two one", None, "", "drei 3.5"]
    for batch in (texts, []):
        made = udfs.hash_embed.func(pa.array(batch, pa.string()))
        assert made.type == pa.list_(pa.float32()) and made.to_pylist() == [np.array(udfs.hash_vector(t or ""), np.float32).tolist() for t in batch]
