"""Vectors of a block against those of another: a matrix product finds the pairs that can count, and only these are computed
one component after the other, as the column expressions do, so that results are theirs to the last digit."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: First vectors that meet the second block at once, and pairs computed at once; what rounding to nine digits can make equal.
ROWS, PAIRS, NEAR = 256, 1 << 16, 2e-9


class Vectors:
    """A column of lists as rows of doubles, shorter ones filled up with zeros; ``hole``: without a value or one of its components."""

    def __init__(self, column: pa.ChunkedArray, width: int = 0):
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        self.size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        row = np.repeat(np.arange(len(self.size)), self.size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.values = np.zeros((len(self.size), max(width, int(self.size.max(initial=0)))))
        self.hole = lists.is_null().to_numpy(zero_copy_only=False).astype(bool)
        self.hole[row[flat.is_null().to_numpy(zero_copy_only=False).astype(bool)]] = True
        self.values[row, at] = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
        with np.errstate(all="ignore"):
            self.squares = np.einsum("ij,ij->i", self.values, self.values)
        # not for the product: squares that overflow or lose digits are compared with all
        self.odd = self.hole | ~((self.squares < 1e250) & ((self.squares > 1e-250) | ~self.values.any(axis=1)))


def pair(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[Vectors, Vectors]:
    x, y = Vectors(a), Vectors(b)
    width = max(x.values.shape[1], y.values.shape[1])
    return tuple(v if v.values.shape[1] == width else Vectors(c, width) for v, c in ((x, a), (y, b)))


def folded(a: np.ndarray, b: np.ndarray, term: Callable) -> np.ndarray:
    """Sums of terms, added from the first component on."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += term(a[:, j], b[:, j])
    return out


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    product = lambda x, y: x * y
    norms = np.sqrt(folded(a, a, product)) * np.sqrt(folded(b, b, product))
    with np.errstate(all="ignore"):
        c = np.where(norms == 0, 0.0, folded(a, b, product) / norms)
    return np.where(np.isnan(c), 1.0, np.clip(c, -1.0, 1.0))  # least() takes NaN for the largest


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(folded(a, b, lambda x, y: (x - y) * (x - y)))


def _exact(f: Callable, x: Vectors, y: Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.concatenate([np.zeros(0), *(f(x.values[i[s : s + PAIRS]], y.values[j[s : s + PAIRS]]) for s in range(0, len(i), PAIRS))])


def _first(i: np.ndarray, value: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest names of each row and value."""
    order = np.lexsort((name, value, i))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (i[order][1:] != i[order][:-1]) | (value[order][1:] != value[order][:-1])
    begins = np.flatnonzero(new)
    return order[np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order)))) < k]


def most_similar(x: Vectors, y: Vectors, names: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, cosine) of what can be the best cosine of a row of x once rounded, at least ``least``; of equal ones the smallest name."""
    made = []
    unit = lambda v: v.values / np.where(v.odd | (v.squares == 0), 1.0, np.sqrt(v.squares))[:, None]
    with np.errstate(all="ignore"):
        a, b = unit(x), np.ascontiguousarray(unit(y).T)
    a[x.odd], b[:, y.odd] = 0, 0
    for s in range(0, len(a), ROWS):
        part = slice(s, s + ROWS)
        about = a[part] @ b
        about[x.size[part, None] != y.size[None, :]] = 0.0
        about[:, y.odd] = -2.0
        keep = about >= np.maximum(about.max(axis=1, initial=-2.0), least)[:, None] - NEAR
        keep[x.odd[part]] = True
        keep[:, y.odd] = True
        i, j = np.nonzero(keep)
        i += s
        other = x.size[i] != y.size[j]
        told = other | ~(x.hole[i] | y.hole[j])
        i, j, other = i[told], j[told], other[told]
        c = np.where(other, 0.0, _exact(_cosines, x, y, i, j))
        at = _first(i, c, names[j], 1)
        made.append((i[at], j[at], c[at]))
    return tuple(np.concatenate([m[n] for m in made]) if made else np.zeros(0, int) for n in range(3))


def nearest(x: Vectors, y: Vectors, asked: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance or -1 if there is none) of what can be among the k nearest of a row of x once rounded, itself left out."""
    made, b = [], np.ascontiguousarray(np.where(y.odd[:, None], 0.0, y.values).T)
    for s in range(0, len(asked), ROWS):
        part = slice(s, s + ROWS)
        about = x.squares[part, None] + y.squares[None, :] - 2 * (np.where(x.odd[part, None], 0.0, x.values[part]) @ b)
        apart = x.size[part, None] != y.size[None, :]
        about[apart] = np.inf
        about[:, y.odd] = np.inf
        keep = np.ones(about.shape, dtype=bool)
        if about.shape[1] > k + 1:
            most = np.partition(about, k, axis=1)[:, k]
            error = 1e-13 * (x.squares[part] + y.squares[~y.odd].max(initial=0.0))
            with np.errstate(all="ignore"):
                keep = ~(about > (most + 2 * error + 4 * NEAR * np.sqrt(np.maximum(most, 0) + error) + NEAR**2)[:, None])
            keep[x.odd[part]] = True
            keep |= apart
            keep[:, y.odd] = True
        i, j = np.nonzero(keep)
        i += s
        own = asked[i] == names[j]
        i, j = i[~own], j[~own]
        none = (x.size[i] != y.size[j]) | x.hole[i] | y.hole[j]
        d = _exact(_distances, x, y, i, j)
        d[none] = -1.0
        at = _first(i, np.where(np.isnan(d), np.inf, d), names[j], k)
        made.append((i[at], j[at], d[at]))
    return tuple(np.concatenate([m[n] for m in made]) if made else np.zeros(0, int) for n in range(3))
