"""Whitening of embeddings by cyclic Jacobi rotations.

1. Sums of the integer vectors, exactly: each entry is cut into three parts whose sums can't overflow.
2. The scatter of centred vectors, summed in each task and then over tasks (common.vector_sum).
3. On the driver, symmetric rotations in cyclic order, all disjoint pairs of a step at once, until every entry off the
   diagonal vanishes beside its two diagonal ones; this keeps small eigenvalues accurate. A dims x dims matrix is all that the
   driver holds.
4. The whitening matrix goes to the tasks (dims x 32 numbers); the covariance of what it makes is measured over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm import common

#: The scale and shift of entries before they are rounded down.
SCALE, SHIFT = 64.0, 1_000_000
#: Dimensions that the driver's matrix may have.
MOST_DIMS = 2048
#: An entry beyond this is no number to whiten: its integer would not be exact.
_LARGEST = 2.0**52
_PART = 21


def _integers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a whole vector of so many finite entries, and their integers."""
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    values = np.array(column.flatten().cast(pa.float64()).fill_null(float("nan")), np.float64) * SCALE
    starts, right = np.cumsum(sizes) - sizes, np.flatnonzero(sizes == dims)
    x = values[starts[right][:, None] + np.arange(dims)]
    whole = (np.abs(x) < _LARGEST).all(1)  # not so for a NaN
    mask = np.zeros(len(sizes), bool)
    mask[right[whole]] = True
    return mask, np.floor(x[whole]).astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches' whole vectors, a few MB at a time; the vector is the last column."""
    step = max(1, most // (8 * dims))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            mask, x = _integers(piece.column(piece.num_columns - 1), dims)
            if len(x):
                yield piece.filter(pa.array(mask)), x


def _commonest(vectors: DataFrame) -> int:
    """The length that most vectors have, the greater of several; 0 if there is none."""
    whole = F.forall("_v", lambda c: c.isNotNull() & (F.abs(c) < F.lit(_LARGEST / SCALE)))
    lengths = vectors.filter(F.col("_v").isNotNull() & (F.size("_v") > 0) & whole).groupBy(F.size("_v").alias("dims")).count()
    row = lengths.orderBy(F.desc("count"), F.desc("dims")).first()
    return row["dims"] if row else 0


class Centre:
    """Differences n * x - S, exactly."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def exact(self, x: np.ndarray) -> np.ndarray:
        near = x - self.base
        if (np.abs(near).max(initial=0) + 1.0) * self.n < 2.0**62:
            return self.n * near - self.rest
        return self.n * near.astype(object) - self.rest.astype(object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.exact(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squared differences; None where a long can't hold one."""
        d = self.exact(x)
        if d.dtype == object or float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] >= 2.0**62:
            d = d.astype(object)
            return [int(s) if s < 1 << 63 else None for s in (d * d).sum(1)]
        return (d * d).sum(1).tolist()


def _sums(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 * dims + 1, np.int64)
        for _, x in _blocks(batches, dims):
            low = (1 << _PART) - 1
            for k, part in enumerate((x & low, (x >> _PART) & low, x >> (2 * _PART))):
                total[k * dims : (k + 1) * dims] += part.sum(0)
            total[-1] += len(x)
        yield from common.vector_parts(total)

    total = common.vector_sum(vectors.mapInArrow(run, common.PARTS), 3 * dims + 1, np.int64).tolist()
    return total[-1], [total[i] + (total[dims + i] << _PART) + (total[2 * dims + i] << (2 * _PART)) for i in range(dims)]


def _scatter(vectors: DataFrame, dims: int, centre: Centre, matrix: np.ndarray | None = None) -> np.ndarray:
    """The covariance, divisor n, of centred vectors, or of their products with a matrix."""
    wide = dims if matrix is None else matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((wide, wide)), np.zeros(wide)
        for _, x in _blocks(batches, dims):
            y = centre.centred(x)
            y = y if matrix is None else y @ matrix
            products += y.T @ y
            sums += y.sum(0)
        yield from common.vector_parts(np.concatenate([products.ravel(), sums]))

    total = common.vector_sum(vectors.mapInArrow(run, common.PARTS), wide * (wide + 1), np.float64)
    mean = total[wide * wide :] / centre.n  # what rounding leaves
    return total[: wide * wide].reshape(wide, wide) / centre.n - np.outer(mean, mean)


def jacobi(a: np.ndarray, most: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix, each with its largest entry positive.

    A sweep meets all pairs in n - 1 steps of disjoint pairs, dealt like the rounds of a tournament.
    """
    a = (a + a.T) / 2
    n = len(a)
    v = np.eye(n)
    seats = np.arange(n + n % 2)
    for _ in range(most):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            there = (p < n) & (q < n)
            p, q = np.minimum(p, q)[there], np.maximum(p, q)[there]
            off, dp, dq = a[p, q], a[p, p], a[q, q]
            large = np.abs(off) > 2.0**-53 * np.sqrt(np.abs(dp * dq))
            if large.any():
                turned = True
                p, q, off, dp, dq = p[large], q[large], off[large], dp[large], dq[large]
                with np.errstate(over="ignore"):
                    ratio = (dq - dp) / (2 * off)
                    t = np.where(ratio < 0, -1.0, 1.0) / (np.abs(ratio) + np.hypot(ratio, 1))
                c = 1 / np.hypot(t, 1)
                s = t * c
                for m, by in ((a, 0), (a, 1), (v, 1)):
                    x, y = (m[p], m[q]) if by == 0 else (m[:, p], m[:, q])
                    cc, ss = (c[:, None], s[:, None]) if by == 0 else (c, s)
                    if by == 0:
                        m[p], m[q] = cc * x - ss * y, ss * x + cc * y
                    else:
                        m[:, p], m[:, q] = cc * x - ss * y, ss * x + cc * y
                a[p, q] = a[q, p] = 0
                a[p, p], a[q, q] = dp - t * off, dq + t * off
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    else:
        raise RuntimeError("rotations did not settle")
    order = np.argsort(-np.diag(a), kind="stable")
    values, v = np.diag(a)[order], v[:, order]
    v = v / np.sqrt((v * v).sum(0))
    return values, v * np.where(v[np.abs(v).argmax(0), np.arange(n)] < 0, -1.0, 1.0)


def whitened(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = 32) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each vector and component up to ``most``.

    A vector that is null or empty, or holds an entry that is null, not finite or beyond 2**46, drops out, as does one of
    another length than most vectors have (the greater length of several). Directions without variance, which rows fewer
    than dimensions or constant entries leave, are no components: with one vector, or equal ones only, there are no rows.
    Repeated rows and rows with a null key stay, each as its own; deviation is null where it is 2**63 or more. Other columns are
    ignored. Raises for more than MOST_DIMS dimensions.
    """
    kind = rows.schema[key].dataType
    out = f"`{key}` {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = rows.select(F.col(vector).cast("array<double>").alias("_v"))
    dims = _commonest(vectors)
    if dims > MOST_DIMS:
        raise ValueError(f"vectors of {dims} dimensions: the driver's matrix has {MOST_DIMS} at most")
    n, sums = _sums(vectors, dims) if dims else (0, [])
    if not n:
        return rows.sparkSession.createDataFrame([], out)
    centre = Centre(n, sums)
    covariance = _scatter(vectors, dims, centre)
    values, axes = jacobi(covariance)
    kept = int((values > dims * 2.0**-52 * max(values[0], 0)).sum())
    kept = min(most, kept)
    if not kept:
        return rows.sparkSession.createDataFrame([], out)
    matrix = axes[:, :kept] / np.sqrt(values[:kept])
    explained = values[:kept] / np.trace(covariance)
    error = float(np.abs(_scatter(vectors, dims, centre, matrix) - np.eye(kept)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _blocks(batches, dims, most=1 << 20):
            m = len(x)
            again = pa.array(np.repeat(np.arange(m), kept))
            columns = [
                piece.column(0).take(again), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, n)), pa.array(centre.deviations(x), pa.int64()).take(again),
                pa.array((centre.centred(x) @ matrix).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(key, F.col(vector).cast("array<double>").alias("_v")).mapInArrow(run, out)
