"""Removal of passages that occur earlier in the corpus, by anchors at difference-cover positions.

A window is ``width`` consecutive words. Positions are covered if they are 0, 1, 3 or 9 modulo 13: any two positions have
a common shift below 13 that takes both to covered ones, so two equal windows of 20 words always share an anchor, the 8
words at some covered position inside both. Only anchors, at 4 of 13 positions, are compared across the corpus first;
windows around an anchor that occurs twice are then extended to their full width and compared by two independent hashes of
64 bits each over all their words, and every window but the first of its kind gives up its words. All passes run over packs (see packs).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm import common, packs, tokens

PERIOD, COVER = 13, (0, 1, 3, 9)
_U = np.uint64


class _Pack:
    """Words, anchors and windows of one pack."""

    def __init__(self, rows: pa.RecordBatch, width: int, bits: int = 64):
        self.rows, self.width, self.anchor, self.bits = rows, width, width - PERIOD + 1, bits
        ids = rows.column(rows.schema.get_field_index("doc_id"))
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.data, self.offsets = tokens.text_buffer(rows.column(rows.schema.get_field_index("text")))
        self.starts, self.ends, self.first = tokens.word_spans(self.data, self.offsets)
        self.hashed = tokens.hash_words(self.data, self.starts, self.ends)
        self.doc = np.repeat(np.arange(rows.num_rows), np.diff(self.first))
        self.position = np.arange(len(self.starts)) - self.first[:-1][self.doc]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of anchors and their hashes."""
        whole = tokens.inside(self.first, self.anchor)
        at = np.flatnonzero(whole & np.isin(self.position[: len(whole)] % PERIOD, COVER) & self.known[self.doc[: len(whole)]])
        return at, tokens.hash_windows(self.hashed, self.anchor)[at]

    def windows(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the windows around the given anchors, and both hashes of them."""
        whole = tokens.inside(self.first, self.width)
        change = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(change, np.maximum(anchors - PERIOD + 1, 0), 1)
        np.add.at(change, anchors + 1, -1)
        at = np.flatnonzero(whole & (np.cumsum(change)[: len(whole)] > 0))
        other = tokens.hash_words(self.data, self.starts, self.ends, other=True) if len(at) else self.hashed
        return at, tokens.hash_windows(self.hashed, self.width)[at] >> _U(64 - self.bits), tokens.hash_windows(other, self.width)[at]


def _anchors_seen_twice(keys: list[np.ndarray], _: pa.Table) -> list[np.ndarray]:
    every = np.concatenate(keys)
    _, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    return np.split(counts[inverse] > 1, np.cumsum([len(k) for k in keys])[:-1])


def _fresh(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Where a pair differs from the one before it."""
    return np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.zeros(0, bool)


def _seen_earlier(keys: list[np.ndarray], table: pa.Table) -> list[np.ndarray]:
    every = np.concatenate(keys)
    doc = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("more0")])
    position = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("more1")])
    other = np.concatenate([np.frombuffer(x.as_buffer(), _U) for x in table.column("more2")])
    order = np.lexsort((position, doc, other, every))
    fresh = _fresh(every[order], other[order])
    lead = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    later = np.zeros(len(every), bool)
    later[order] = (doc[order] != doc[lead]) | (position[order] != position[lead])
    return np.split(later, np.cumsum([len(k) for k in keys])[:-1])


def _repeated_anchors(pack: _Pack, answers: pa.Scalar, n_buckets: int) -> np.ndarray:
    at, hashes = pack.anchors()
    keys, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    return at[((counts > 1) | packs.decoded(answers, keys, n_buckets))[inverse]]


class _Kinds:
    """A pack's distinct windows: both hashes, the kind of each place, and the first place's document and position."""

    def __init__(self, pack: _Pack, at: np.ndarray, one: np.ndarray, two: np.ndarray):
        order = np.lexsort((two, one))  # stable, so places of one kind stay in their order
        fresh = _fresh(one[order], two[order])
        first = order[fresh]
        self.keys, self.others = one[first], two[first]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(fresh) - 1
        self.doc, self.position = pack.ids[pack.doc[at[first]]], pack.position[at[first]]


def without_repeats(docs: DataFrame, width: int = 20, join_words: bool = True, bits: int = 64) -> DataFrame:
    """Every row of docs with its text less the words that repeat an earlier passage, n_words and n_removed.

    A word goes if a window of ``width`` words that covers it also starts earlier: in a smaller doc_id, or before it in the
    same document; windows are judged on the input. The kept words are joined by one space; with ``join_words`` false, a
    text that loses nothing stays as it is. A null or empty text has no words and becomes empty. Rows with a null doc_id
    lose nothing and are not compared. Rows repeated with one doc_id count as one occurrence and lose the same words.
    Input columns named n_words or n_removed are replaced; all others are carried. An empty table gives no rows. ``bits`` is
    how many the first hash of a window has; with fewer, windows collide, which changes no result.
    """
    if width < PERIOD:
        raise ValueError(f"windows of fewer than {PERIOD} words have no anchor")
    kinds = {"doc_id": "long", "text": "string"}
    docs = docs.select(*[F.col(f"`{c}`").cast(kinds.get(c, t)).alias(c) for c, t in docs.dtypes if c not in ("n_words", "n_removed")])
    packed = packs.packed(docs)
    n_buckets = packs.buckets_for(common.text_bytes(docs))

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, hashes = _Pack(packs.unpacked(rows), width).anchors()
                yield packs.questions(name, tokens.distinct(hashes), n_buckets, 4)

    asked = packed.mapInArrow(ask_anchors, "pack long, bucket int, keys binary")
    seen_twice = packs.answered(asked, _anchors_seen_twice, 4, "anchors")
    with_anchors = packed.join(common.stage(seen_twice), "pack", "left")

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rows, answers in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                pack = _Pack(packs.unpacked(rows), width, bits)
                kinds = _Kinds(pack, *pack.windows(_repeated_anchors(pack, answers, n_buckets)))
                yield packs.questions(name, kinds.keys, n_buckets, 8, kinds.doc, kinds.position, kinds.others)

    asked = with_anchors.mapInArrow(ask_windows, "pack long, bucket int, keys binary, more0 binary, more1 binary, more2 binary")
    earlier = packs.answered(asked, _seen_earlier, 8, "windows")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, anchors, windows in zip(batch.column(1), batch.column(2), batch.column(3)):
                pack = _Pack(packs.unpacked(rows), width, bits)
                at, one, two = pack.windows(_repeated_anchors(pack, anchors, n_buckets))
                kinds = _Kinds(pack, at, one, two)
                later = packs.decoded(windows, kinds.keys, n_buckets)[kinds.of]
                later |= (pack.ids[pack.doc[at]] != kinds.doc[kinds.of]) | (pack.position[at] != kinds.position[kinds.of])
                change = np.zeros(len(pack.starts) + 1, np.int64)
                change[at[later]] += 1
                change[at[later] + width] -= 1
                gone = np.cumsum(change)[:-1] > 0
                lost = np.concatenate([[0], np.cumsum(gone)])[pack.first]
                texts = []
                raw = pack.data.tobytes()
                for i in range(pack.rows.num_rows):
                    text = raw[pack.offsets[i] : pack.offsets[i + 1]]
                    if lost[i + 1] > lost[i]:
                        kept = ~gone[pack.first[i] : pack.first[i + 1]]
                        texts.append(b" ".join([w for w, k in zip(text.split(), kept.tolist()) if k]))
                    else:
                        texts.append(b" ".join(text.split()) if join_words else text)
                columns = {n: pack.rows.column(i) for i, n in enumerate(pack.rows.schema.names)}
                columns["text"] = pa.array(texts, pa.binary()).cast(pa.string())
                columns["n_words"], columns["n_removed"] = pa.array(np.diff(pack.first), pa.int64()), pa.array(np.diff(lost), pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    final = with_anchors.join(earlier, "pack", "left").select("pack", "rows", "anchors", "windows")
    return final.mapInArrow(remove, f"{fields}, n_words long, n_removed long")
