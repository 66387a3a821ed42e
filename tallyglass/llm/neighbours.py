"""Quality by nearest neighbours: labelled texts vote in a latent-semantic space.

1. Terms of a text are its words and the shapes of its words (classes of characters with runs as one, whether a word repeats
   the one before), hashed, and its length in powers of two. Words weigh by the inverse of their document frequency over all
   texts, shapes by their share; each of the three kinds has a length of its own.
2. At most FIT_ROWS labelled texts, those of smallest hash, are the fit: their matrix is decomposed on the driver by subspace
   iteration, which gives the latent directions, and its rows are the voters.
3. Directions and voters (a few MB, whatever the input) are broadcast. Every document's cosine with every voter is computed
   exactly in blocks; the nearest ones vote with a power of their similarity as weight.

Only labels decide what is good; language, source and ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm import common, tokens

#: Hashed words and shapes, powers of two in lengths, and all of them.
WORDS, SHAPES, LENGTHS = 8192, 1024, 32
TERMS = WORDS + SHAPES + LENGTHS
#: Weights of words, shapes and length.
WEIGHTS = (0.4, 1.0, 0.25)
#: Labelled rows of the fit at most, latent directions, voters of a document, the power of similarity that weighs a vote.
FIT_ROWS, DIRECTIONS, VOTERS, POWER = 4096, 64, 24, 8
#: Documents whose cosines stand in memory together.
BLOCK = 512
_U = np.uint64

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = ord("a"), ord("A"), ord("0"), ord("a")


@dataclass(frozen=True)
class Fit:
    """What a document needs to be scored: weights of words, directions, voters and their labels, and the share of good ones."""

    idf: np.ndarray
    directions: np.ndarray
    voters: np.ndarray
    good: np.ndarray
    share: float


def _term_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, occurrences) of the texts' terms, sorted by row, and the number of words of each text."""
    data, offsets = tokens.text_buffer(column)
    starts, ends, first = tokens.word_spans(data, offsets)
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), n)
    hashed = tokens.hash_words(data, starts, ends, lower=True)
    classes = _CLASS[data]
    new = np.ones(len(data), bool)
    new[1:] = classes[1:] != classes[:-1]
    new[starts] = True
    before = np.concatenate([[0], np.cumsum(new)])
    shapes = tokens.hash_words(classes[new], before[starts], before[ends]) % _U(SHAPES - 1)
    again = np.zeros(len(starts), bool)
    again[1:] = hashed[1:] == hashed[:-1]
    again[first[:-1][n > 0]] = False
    shapes[again] = SHAPES - 1
    size = WORDS + SHAPES
    keys = np.concatenate([rows * size + (hashed % _U(WORDS)).astype(np.int64), rows * size + WORDS + shapes.astype(np.int64)])
    keys, times = np.unique(keys, return_counts=True)
    return keys // size, keys % size, times, n


def _weighted(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the texts' terms, sorted by row."""
    row, term, times, n = _term_ids(column)
    word = term < WORDS
    weight = np.where(word, (1 + np.log(times)) * idf[np.minimum(term, WORDS - 1)], np.sqrt(times))
    kind = row * 2 + ~word
    norm = np.sqrt(np.bincount(kind, weight * weight, minlength=2 * len(n)))[kind]
    weight = weight / np.where(norm > 0, norm, 1) * np.where(word, WEIGHTS[0], WEIGHTS[1])
    # the length stands on two neighbouring powers of two
    power = np.minimum(np.log2(n + 1.0), LENGTHS - 1.001)
    low = power.astype(np.int64)
    angle = (power - low) * (np.pi / 2)
    at = np.concatenate([row, np.arange(len(n)), np.arange(len(n))])
    term = np.concatenate([term, WORDS + SHAPES + low, WORDS + SHAPES + low + 1])
    weight = np.concatenate([weight, WEIGHTS[2] * np.cos(angle), WEIGHTS[2] * np.sin(angle)])
    order = np.argsort(at, kind="stable")
    return at[order], term[order], weight[order]


def _latent(column: pa.Array, idf: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Unit vectors of the texts in the latent space; a text without any part there is zero."""
    out = np.zeros((len(column), directions.shape[1]))
    row, term, weight = _weighted(column, idf)
    step = 1 << 17
    for at in range(0, len(row), step):
        r, part = row[at : at + step], weight[at : at + step, None] * directions[term[at : at + step]]
        begin = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        out[r[begin]] += np.add.reduceat(part, begin, axis=0)
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(length > 1e-9, length, np.inf)


def _frequencies(docs: DataFrame) -> np.ndarray:
    """In how many texts each hashed word occurs, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WORDS + 1, np.int64)
        for batch in batches:
            for piece in tokens.slices(batch):
                _, term, _, n = _term_ids(piece.column(0))
                total[:WORDS] += np.bincount(term[term < WORDS], minlength=WORDS)
                total[-1] += len(n)
        yield from common.vector_parts(total)

    return common.vector_sum(docs.select("text").mapInArrow(run, common.PARTS), WORDS + 1, np.int64)


def _fit_rows(docs: DataFrame, labels: DataFrame, most: int) -> list:
    """At most so many labelled rows with their terms and weights of terms without idf, those of smallest hash.

    The choice is made on ids first, so that only chosen texts are looked at, and again on rows, as ids may repeat.
    """
    picked = (
        labels.filter("doc_id is not null and quality is not null").filter(~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tokens.slices(batch):
                row, term, times, n = _term_ids(piece.column(3))
                borders = np.searchsorted(row, np.arange(len(n) + 1))
                cut = lambda values, kind: tokens.blobs([values[a:b].astype(kind).tobytes() for a, b in zip(borders, borders[1:])])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], pa.array(n, pa.int64()), cut(term, np.uint16), cut(times, np.int32)], names=["doc_id", "_quality", "_order", "n", "terms", "times"])

    chosen = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "_quality", F.xxhash64("text").alias("_order"), "text")
    made = chosen.mapInArrow(run, "doc_id long, _quality int, _order long, n long, terms binary, times binary")
    return made.orderBy(F.xxhash64("doc_id"), "doc_id", "_order").limit(most).collect()


def held_out(key: str) -> F.Column:
    """Whether a row's label takes no part in learning."""
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def _directions(matrix: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """The k strongest right singular directions, by subspace iteration from fixed numbers."""
    k = max(1, min(k, *matrix.shape))
    wide = min(k + 16, *matrix.shape)
    basis = np.random.default_rng(7).standard_normal((matrix.shape[1], wide)).astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(matrix.T @ (matrix @ np.linalg.qr(basis)[0]))[0]
    _, _, right = np.linalg.svd(matrix @ basis, full_matrices=False)
    return (basis @ right[:k].T).astype(np.float64)


def learn(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Fit | None:
    """The fit on at most ``most`` labelled rows (doc_id, quality: 1 is good) of docs (doc_id, text); None without any."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = _fit_rows(docs, labels, most)
    if not rows:
        return None
    seen = _frequencies(docs)
    idf = np.log((seen[-1] + 1) / (seen[:-1] + 1)) + 0.05
    matrix = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        term, times = np.frombuffer(r["terms"], np.uint16).astype(np.int64), np.frombuffer(r["times"], np.int32)
        _fill(matrix[i], term, times, r["n"], idf)
    directions = _directions(matrix, DIRECTIONS)
    voters = matrix.astype(np.float64) @ directions
    length = np.sqrt((voters * voters).sum(1, keepdims=True))
    good = np.array([r["_quality"] == 1 for r in rows], np.float64)
    return Fit(idf, directions, voters / np.where(length > 1e-9, length, np.inf), good, float(good.mean()))


def _fill(out: np.ndarray, term: np.ndarray, times: np.ndarray, n: int, idf: np.ndarray) -> None:
    """One text's weights, as _weighted has them."""
    word = term < WORDS
    weight = np.where(word, (1 + np.log(times)) * idf[np.minimum(term, WORDS - 1)], np.sqrt(times))
    for kind, scale in ((word, WEIGHTS[0]), (~word, WEIGHTS[1])):
        norm = np.sqrt((weight[kind] ** 2).sum())
        out[term[kind]] = weight[kind] / norm * scale if norm > 0 else 0
    power = min(np.log2(n + 1.0), LENGTHS - 1.001)
    angle = (power - int(power)) * (np.pi / 2)
    out[WORDS + SHAPES + int(power)], out[WORDS + SHAPES + int(power) + 1] = WEIGHTS[2] * np.cos(angle), WEIGHTS[2] * np.sin(angle)


def _votes(vectors: np.ndarray, fit: Fit) -> np.ndarray:
    """The weighted share of good ones among the nearest voters; the share in the fit where none is similar at all."""
    out, k = np.empty(len(vectors)), min(VOTERS, len(fit.voters))
    for at in range(0, len(vectors), BLOCK):
        cosines = vectors[at : at + BLOCK] @ fit.voters.T
        nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, nearest, 1), 0) ** POWER
        total = weight.sum(1)
        out[at : at + BLOCK] = np.where(total > 0, (weight * fit.good[nearest]).sum(1) / np.where(total > 0, total, 1), fit.share)
    return np.clip(out, 0, 1)


def scored(docs: DataFrame, fit: Fit | None, good_from: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text).

    A null text counts as empty; an empty one has a length and is scored by it. Without a fit every score is 0.5. Repeated
    rows are scored each, a null doc_id is not held out, and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tokens.slices(batch):
                score = np.full(piece.num_rows, 0.5) if fit is None else _votes(_latent(piece.column(2), fit.idf, fit.directions), fit)
                predicted = pa.array((score >= good_from).astype(np.int32))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(score), predicted], names=["doc_id", "held_out", "score", "predicted"])

    out = F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
