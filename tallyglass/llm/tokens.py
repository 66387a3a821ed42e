"""Words and their hashes over whole Arrow columns, in numpy.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; these are all ASCII, so bytes and code points agree on
the borders. A column's texts lie end to end in one buffer, and every step runs over that buffer rather than over rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; bounds the eight-byte arrays that hashing needs, also inside one very long text.
BLOCK = 1 << 20
_U = np.uint64
_STEP, _SEED = 0x9E3779B97F4A7C15 | 1, 0x5DEECE66D
_MASK = (1 << 64) - 1

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of murmur3: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_CODE = mix(np.arange(1, 257, dtype=_U) * _U(_SEED))
_CODE_LOWER = _CODE[LOWER]
_CODE_OTHER = mix(np.arange(1, 257, dtype=_U) * _U(0x2545F4914F6CDD1D))
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd step and of its inverse modulo 2**64, up to n of them."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            table = np.full(max(n, BLOCK + 1), base & _MASK, _U)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=_U)
    return _powers[0], _powers[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (one more than rows, from 0); nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if what is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(what, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word (one more entry than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    separator = SEPARATOR[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    border[n] = True
    before = border[:n].copy()
    before[1:] |= separator[:-1]
    after = border[1:]
    after[:-1] |= separator[1:]
    word = ~separator
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, other: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; lower folds A-Z, other gives a second hash that knows nothing of the first."""
    out, code = np.empty(len(starts), _U), _CODE_LOWER if lower else _CODE_OTHER if other else _CODE
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(int(np.searchsorted(ends, base + BLOCK, "right")), at + 1)
        s, e = starts[at:to] - base, ends[at:to] - base
        up, down = _power_tables(int(e[-1]) + 1)
        total = np.zeros(int(e[-1]) + 1, _U)
        np.cumsum(code[data[base : base + e[-1]]] * up[: e[-1]], dtype=_U, out=total[1:])
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U))
        at = to
    return out


def hash_windows(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width consecutive word hashes, wherever it starts (also across texts)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = words[:n].copy()
    for k in range(1, width):
        out *= _U(_STEP)
        out += words[k : k + n]
    return mix(out)


def inside(first: np.ndarray, width: int) -> np.ndarray:
    """Which windows of hash_windows lie in one text."""
    n = int(first[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n + width, bool)
    borders = first[1:-1]
    for k in range(1, width):
        ok[np.maximum(borders - k, 0)[borders - k >= 0]] = False
    return ok[:n]


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order, by sorting, which is many times faster here than by hashing."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most so many bytes of text; a longer text is a piece of its own."""
    data, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1, at + 1)
        yield batch.slice(at, to - at)
        at = to


def ragged(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of the values from first[i] to first[i + 1]."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


def blobs(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
