"""Folds in blocks against plain Python, with one key that holds nearly all rows."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyglass import schemas
from tallyglass.functions import folds
from tallyglass.operators import ledger, measure, sequences


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    load = [rng.choice([20.0, 70.0, 95.0, 130.0, 250.0]) for _ in range(12)]
    return [(1 if i % 40 else i % 7, i * 3, i // 2, rng.gauss(load[i // 250], 15)) for i in range(3000)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "tenant long, request_id long, ts long, overhead_ms double").repartition(5).cache()


def _by_tenant(rows):
    out = defaultdict(list)
    for tenant, request, ts, ms in sorted(rows, key=lambda r: (r[2], r[1])):
        out[tenant].append((request, ms))
    return out


def test_places_have_no_gaps(df, rows, monkeypatch):
    monkeypatch.setattr(folds, "BLOCK", 64)
    got = {r["request_id"]: (r["_at"], r["_block"]) for r in folds.placed(df, ["tenant"], ["ts", "request_id"]).collect()}
    assert got == {request: (i, i // 64) for of in _by_tenant(rows).values() for i, (request, _) in enumerate(of)}


def test_running_values(df, rows, monkeypatch):
    monkeypatch.setattr(folds, "BLOCK", 50)
    placed = folds.placed(df, ["tenant"], ["ts", "request_id"])
    for inclusive in (True, False):
        values = {"total": ("sum", F.col("request_id")), "most": ("max", F.col("overhead_ms"))}
        got = {r["request_id"]: (r["total"], r["most"]) for r in folds.running(placed, ["tenant"], values, inclusive).collect()}
        for of in _by_tenant(rows).values():
            total, most = 0, None
            for request, ms in of:
                before = (total, most)
                total, most = total + request, ms if most is None else max(most, ms)
                assert got[request] == ((total, most) if inclusive else before)


def test_rolling_p95_and_governor(spark, df, rows, monkeypatch):
    monkeypatch.setattr(folds, "BLOCK", 256)
    p95 = {r["request_id"]: r["p95_ms"] for r in ledger.rolling_p95(df).collect()}
    state = {r["request_id"]: r["state"] for r in sequences.governor_trace(df, "tenant").collect()}
    seen = set()
    for of in _by_tenant(rows).values():
        now = 0
        for i, (request, _) in enumerate(of):
            recent = [ms for _, ms in of[max(0, i - 199) : i + 1]]
            assert p95[request] == sorted(recent)[round(0.95 * (len(recent) - 1))]
            now = sequences.step_governor(now, recent)
            assert state[request] == schemas.GOVERNOR[now]
            seen.add(now)
    assert len(p95) == len(state) == len(rows) and seen == {0, 1, 2, 3, 4}
    monkeypatch.setattr(folds, "BLOCK", 100)
    with pytest.raises(ValueError, match="look back"):
        ledger.rolling_p95(df)


def test_evalues(spark, rows, monkeypatch):
    monkeypatch.setattr(folds, "BLOCK", 100)
    rng = random.Random(9)
    data = [(tenant, request, None if rng.random() < 0.01 else float(rng.random() < 0.12)) for tenant, request, *_ in rows]
    got = {r["request_id"]: r for r in measure.evalues(spark.createDataFrame(data, "tenant long, request_id long, x double").repartition(4), ["tenant"], ["request_id"]).collect()}
    by = defaultdict(list)
    for tenant, request, x in sorted(data, key=lambda r: r[1]):
        by[tenant].append((request, x))
    for of in by.values():
        before, log_e, most = [], 0.0, 0.0
        for request, x in of:
            bet, n = 0.0, len(before)
            mean = sum(before) / n if n else 0.0
            if n >= 10 and mean > 0.05:
                spread = max(1e-12, sum(v * v for v in before) / n - mean**2)
                bet = min((mean - 0.05) / (spread + (mean - 0.05) ** 2), 10.0)
            if x is not None:
                log_e += math.log(1 + bet * (x - 0.05))
                before.append(x)
            most = max(most, log_e)
            r = got[request]
            assert r["bet"] == pytest.approx(bet, abs=1e-9) and math.log(r["e_value"]) == pytest.approx(log_e, abs=1e-8)
            assert math.log(r["max_e"]) == pytest.approx(most, abs=1e-8) and r["alerted"] == (r["max_e"] >= 20)
    assert len(got) == len(rows)


def test_evalues_of_a_long_key_stay_finite(spark):
    n = 3000
    data = [(k, i, float(k == 0 or i < 10)) for k in (0, 1) for i in range(n)]
    got = measure.evalues(spark.createDataFrame(data, "g long, i long, x double"), ["g"], ["i"]).select("g", "i", "log_e").collect()
    assert len(got) == 2 * n and all(r["log_e"] is not None and math.isfinite(r["log_e"]) for r in got)
    last = {r["g"]: r["log_e"] for r in got if r["i"] == n - 1}
    # all ones: the bet is 1 / 0.95, so each step from the tenth on is ln(2); exp(2070) is no double
    assert abs(last[0] - (n - 10) * math.log(2)) < 1e-6 and last[0] > 710
