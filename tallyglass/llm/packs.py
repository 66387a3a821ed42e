"""Rows in packs: a few MB of texts as one compressed row, written once and read by every pass of an operator.

Passes that look at whole texts several times, with a question to all other texts in between, go over packs. A pack asks
by sending, for each of a number of buckets, the keys it is interested in, as one row of bytes; the bucket sees the keys
of all packs and answers each with one bit per key in the order asked. Neither texts nor single keys are shuffled as rows.
A pack asks each key once, however often it holds it, so a bucket gets a hot key at most once from each pack.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm import common, tokens

PACK_BYTES = 4 << 20
#: Bytes of text for each bucket of keys; the number of buckets follows the input.
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 24
_U = np.uint64


def packed(docs: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(pack, rows): rows in Arrow's stream format, each pack's sorted by doc_id; written to the shared folder.

    A pack holds at most pack_bytes of text, or one longer text.

    Needs the columns doc_id (long) and text (string); all others are carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            for piece in tokens.slices(batch, most=pack_bytes):
                piece = piece.sort_by("doc_id") if piece.num_rows > 1 else piece
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema, options=options) as writer:
                    writer.write_batch(piece)
                name = int.from_bytes(os.urandom(8), "little", signed=True)
                yield pa.RecordBatch.from_arrays([pa.array([name]), tokens.blobs([sink.getvalue().to_pybytes()])], names=["pack", "rows"])

    return common.stage(docs.mapInArrow(run, "pack long, rows binary"))


def unpacked(rows: pa.Scalar) -> pa.RecordBatch:
    table = pa.ipc.open_stream(rows.as_buffer()).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def buckets_for(n_bytes: int) -> int:
    return max(LEAST_BUCKETS, n_bytes // BUCKET_BYTES)


def by_bucket(keys: np.ndarray, n_buckets: int) -> list[np.ndarray]:
    """For each bucket, the places of its keys in ascending order; keys are hashes."""
    bucket = ((keys >> _U(32)) % _U(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.searchsorted(bucket[order], np.arange(1, n_buckets)))


def questions(pack: int, keys: np.ndarray, n_buckets: int, width: int, *more: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket with keys: the pack, the bucket, the keys in width bytes, and more arrays as bytes."""
    places = [(b, at) for b, at in enumerate(by_bucket(keys, n_buckets)) if len(at)]
    kind = np.uint32 if width == 4 else _U
    columns = [pa.array([pack] * len(places), pa.int64()), pa.array([b for b, _ in places], pa.int32())]
    columns += [tokens.blobs([x[at].tobytes() for _, at in places]) for x in (keys.astype(kind), *more)]
    return pa.RecordBatch.from_arrays(columns, names=["pack", "bucket", "keys", *(f"more{i}" for i in range(len(more)))])


def answered(asked: DataFrame, answer: Callable[[list[np.ndarray], pa.Table], list[np.ndarray]], width: int, name: str) -> DataFrame:
    """(pack, name): for every pack the answers of its buckets, as an array of (bucket, bits)."""
    kind = np.uint32 if width == 4 else _U

    def run(table: pa.Table) -> pa.Table:
        bits = answer([np.frombuffer(x.as_buffer(), kind) for x in table.column("keys")], table)
        columns = [table.column("pack"), table.column("bucket"), tokens.blobs([np.packbits(b).tobytes() for b in bits])]
        return pa.table(columns, names=["pack", "bucket", "bits"])

    rows = asked.groupBy("bucket").applyInArrow(run, "pack long, bucket int, bits binary")
    return rows.groupBy("pack").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))


def decoded(answers: pa.Scalar, keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """One boolean for each key that was asked."""
    out = np.zeros(len(keys), bool)
    given = {x["bucket"]: x["bits"] for x in answers.as_py() or ()}
    for b, at in enumerate(by_bucket(keys, n_buckets)):
        if len(at):
            out[at] = np.unpackbits(np.frombuffer(given[b], np.uint8), count=len(at)).astype(bool)
    return out
