"""Candidate policies replayed over cases with known answers: all candidates and all seeds in one pass over the cases.

A case's probabilities are read once. Within a task every candidate's losses are worked out over the whole batch, and only
counts leave the task: one row for each candidate and seed. So neither candidates nor seeds multiply the rows that are shuffled.
Seeds are columns of weights: how often a case stands in the set that a seed draws.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass import policy, schemas

COUNTS = ("cases", "false_interventions", "escapes", "disruptive")


def weight(key: Column, seed: int, most: int = 3) -> Column:
    """How often a case is in a seed's set, from 0 to most - 1, by a hash of both."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(most))


def _losses(p: np.ndarray, impact: np.ndarray, reverse: np.ndarray, candidate: tuple[float, float, float], book: dict, defect: str) -> np.ndarray:
    """The action of each case under a candidate (impact scale, deadband, nuisance multiplier), by its place in the ladder."""
    scale, band, nuisance = candidate
    live = np.maximum(0.0, p - band)
    harm, clean = live * impact * scale * reverse, 1 - live
    totals = []
    for act in schemas.ACTIONS:
        fixed = book["compute_tokens"][act] * book["price_inr_per_1k_tokens"] / 1000 + (book["review_cost_inr"] if act in ("L4_hold", "L5_block") else 0.0)
        late = book["lambda_time_inr_per_second"] * book["latency_ms"][act] / 1000
        left = 1 - book["efficacy"].get(act, {}).get(defect, 0.0)
        totals.append(np.round(harm * left + clean * book["nuisance_inr"][act] * nuisance + fixed + late, 6))
    return np.argmin(np.stack(totals), axis=0)  # of equal losses the lower rung


def evaluated(cases: DataFrame, candidates: list[tuple[int, float, float, float]], seeds: list[int], book: dict = policy.POLICY, defect: str = "ungrounded") -> DataFrame:
    """(candidate, seed, cases, false_interventions, escapes, disruptive) for each candidate and seed.

    cases has case_id, p, impact_inr, reversibility and defective. A case with a null among them is left out of every count.
    Disruptive are holds and blocks. candidates are (id, impact scale, deadband, nuisance multiplier) and few, as all go to
    every task.
    """
    hold = schemas.ACTIONS.index("L4_hold")
    reverse = F.coalesce(*[F.when(F.col("reversibility") == r, F.lit(float(x))) for r, x in book["reversibility"].items()])
    rows = cases.select(
        F.col("p").cast("double").alias("p"), F.col("impact_inr").cast("double").alias("impact"), reverse.alias("reverse"), F.col("defective").cast("boolean").alias("defective"),
        *[weight(F.col("case_id"), s).alias(f"w{i}") for i, s in enumerate(seeds)],
    ).na.drop()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(candidates), len(seeds), len(COUNTS)), np.int64)
        for batch in batches:
            p, impact, by = (np.asarray(batch.column(i)) for i in range(3))
            defective = np.asarray(batch.column(3).to_numpy(zero_copy_only=False), bool)
            weights = np.stack([np.asarray(batch.column(4 + i)) for i in range(len(seeds))])
            total[:, :, 0] += weights.sum(1)
            for c, (_, *candidate) in enumerate(candidates):
                action = _losses(p, impact, by, tuple(candidate), book, defect)
                seen = np.stack([(action > 0) & ~defective, (action == 0) & defective, action >= hold]).astype(np.int64)
                total[c, :, 1:] += weights @ seen.T
        ids = np.repeat([c[0] for c in candidates], len(seeds)).astype(np.int32)
        at = np.tile(np.array(seeds, np.int32), len(candidates))
        columns = [pa.array(ids), pa.array(at), *[pa.array(total[:, :, k].ravel()) for k in range(len(COUNTS))]]
        yield pa.RecordBatch.from_arrays(columns, names=["candidate", "seed", *COUNTS])

    parts = rows.mapInArrow(run, "candidate int, seed int, " + ", ".join(f"{c} long" for c in COUNTS))
    return parts.groupBy("candidate", "seed").agg(*[F.sum(c).alias(c) for c in COUNTS])


def compared(results: DataFrame, shipped: int) -> DataFrame:
    """(candidate, worst_*, seeds, verdict): each candidate by its worst seed, and why it is out or stays.

    A candidate is out if in its worst seed more escapes than under the shipped one in its own worst, or if another that isn't
    out is nowhere worse and somewhere better; what stays is the frontier. Candidates are few, so they are compared with each other.
    """
    names = ("false_interventions", "escapes", "disruptive")
    worst = results.groupBy("candidate").agg(F.count("*").alias("seeds"), *[F.max(c).alias(f"worst_{c}") for c in names])
    base = results.filter(F.col("candidate") == shipped).agg(F.max("escapes")).first()[0]
    gated = worst.withColumn("_open", F.col("worst_escapes") <= F.lit(base).cast("long"))
    x, y = gated.alias("x"), gated.filter("_open").alias("y")
    no_worse, better = F.lit(True), F.lit(False)
    for c in names:
        no_worse, better = no_worse & (F.col(f"y.worst_{c}") <= F.col(f"x.worst_{c}")), better | (F.col(f"y.worst_{c}") < F.col(f"x.worst_{c}"))
    beaten = x.join(F.broadcast(y), no_worse & better, "left_semi").select("candidate", F.lit(True).alias("_beaten"))
    verdict = F.when(~F.col("_open"), "more escapes than shipped").when(F.col("_beaten"), "dominated").otherwise("frontier")
    return gated.join(beaten, "candidate", "left").select("candidate", "seeds", *[f"worst_{c}" for c in names], verdict.alias("verdict"))
