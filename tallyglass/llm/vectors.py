"""Near-duplicate vectors by an inverted multi-index.

Each half of the unit vectors has a codebook; a pair of codewords is a cell of the product grid, and every vector lies in
the cell of its nearest codewords. For a query, the distance to the border between its own codeword's region and another's
is a lower bound of what separates it from anything there; the two sorted lists of squared bounds are merged as in
multi-sequence search, and cells are visited in that order until the sum passes a stopping bound. At the squared distance
of the threshold itself nothing can be missed; the bound used is the smallest that finds the target share of true links of
sample queries, measured by brute force against all vectors, with a margin. Links count there so that every group of the
sample weighs the same, and where the sample has too few groups the exact bound is used. What is visited is verified by
cosine in double precision, and a link counts for both ends whichever query found it. Equal vectors are one node with a
weight, so copies cost nothing.

Queries and members meet in blocks of bounded size. A block holds members of one row of the grid (one codeword of the first
half), and a query goes to each row once with the list of its cells there; rows with many members or queries are cut into
several blocks. A block returns link counts and a spanning forest of its links, never the pairs.

Vectors of several lengths share the codebooks: these see the first components, as many as the most frequent length has
(zeros behind shorter ones), where distances are never larger, so the bounds hold. Lengths never meet in a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm import common, tokens

#: Vectors that the codebooks are fitted on at most, which are the sample queries for the stopping bound, and rows of a block.
FIT_VECTORS, MEMBERS, QUERIES = 8192, 4096, 4096
#: Share of true links that the stopping bound must reach, the factor on it, and its least share of the exact bound.
TARGET, MARGIN, LEAST = 0.9995, 1.5, 0.03
#: Vectors of a cell that the size of the codebooks aims at, and codewords of a half at least and at most.
PER_CELL, CODEWORDS = 50, (4, 512)
#: Groups of linked sample queries below which nothing is concluded from them.
ENOUGH = 128
_BINS = 400


def _units(column: pa.Array) -> list[bytes | None]:
    """Each vector at length 1 as bytes; nothing for one that is null, empty or zero or has a part that isn't finite."""
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    values = column.flatten().cast(pa.float64())
    values = np.array(values.fill_null(float("nan")), np.float64)
    ends = np.cumsum(sizes)
    some = np.flatnonzero(sizes)
    out: list[bytes | None] = [None] * len(sizes)
    if len(some):
        starts = (ends - sizes)[some]
        top = np.maximum.reduceat(np.abs(values), starts)
        good = np.isfinite(top) & (top > 0)
        with np.errstate(all="ignore"):
            values = values / np.repeat(top, sizes[some])
            values = values / np.repeat(np.sqrt(np.add.reduceat(values * values, starts)), sizes[some])
        for i, start, ok in zip(some.tolist(), starts.tolist(), good.tolist()):
            out[i] = values[start : start + sizes[i]].tobytes() if ok else None
    return out


def _codebook(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(7)
    points = np.unique(sample, axis=0)
    k = min(k, len(points))
    centers = points[[int(rng.integers(len(points)))]]
    near = ((points - centers[0]) ** 2).sum(1)
    for _ in range(k - 1):
        pick = int(np.searchsorted(np.cumsum(near), rng.random() * near.sum())) if near.sum() > 0 else 0
        centers = np.vstack([centers, points[min(pick, len(points) - 1)]])
        near = np.minimum(near, ((points - centers[-1]) ** 2).sum(1))
    for _ in range(rounds):
        own = _squared(points, centers).argmin(1)
        for c in range(k):
            if (own == c).any():
                centers[c] = points[own == c].mean(0)
    return np.unique(centers, axis=0)


def _squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)[None], 0)


def _bounds(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each row, and squared distances to the borders of the others' regions."""
    d = _squared(x, centers)
    own = d.argmin(1)
    between = np.sqrt(_squared(centers, centers))
    gap = between[own]
    h = np.divide(d - d[np.arange(len(x)), own][:, None], 2 * gap, out=np.zeros_like(d), where=gap > 0)
    return own, np.maximum(h, 0) ** 2


class _Index:
    """Codebooks of both halves; small, and shipped with the functions that use it."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        self.books = (_codebook(sample[:, : self.half], k), _codebook(sample[:, self.half :], k))
        self.width = len(self.books[1])

    def look(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, left = _bounds(x[:, : self.half], self.books[0])
        b, right = _bounds(x[:, self.half :], self.books[1])
        return a * self.width + b, left, right

    def visits(self, x: np.ndarray, stop: float, full: np.ndarray) -> list[np.ndarray]:
        """For each query the cells of a multi-sequence search up to the stopping bound that are full, sorted."""
        _, left, right = self.look(x)
        out = []
        for a, b in zip(left, right):
            rows, columns = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
            reach = np.searchsorted(b[columns], stop - a[rows], "right")
            n = int(np.searchsorted(a[rows], stop, "right"))
            cells = np.concatenate([rows[i] * self.width + columns[: reach[i]] for i in range(n)])
            out.append(np.sort(cells[full[cells]]))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = tokens.text_buffer(column)
    return data.view(np.float64).reshape(len(column), -1)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length its rows' places and vectors."""
    sizes = np.asarray(pc.binary_length(column)) // 8
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield int(size), at, _matrix(column.take(pa.array(at)))


def _view(column: pa.Array, dims: int) -> np.ndarray:
    """The first components of each vector, zeros behind shorter ones."""
    out = np.zeros((len(column), dims))
    for size, at, x in _by_length(column):
        out[at, : min(size, dims)] = x[:, :dims]
    return out


def _share(met: np.ndarray, seen: np.ndarray) -> float:
    """The stopping bound as a share of the exact one; seen has each probe's links with others by how far off they lie.

    A probe's links weigh one together, divided by the linked probes that it meets, so a group of many weighs as one of two.
    """
    linked = seen.sum(1) > 0
    weight = 1 / np.maximum(met[linked], 1)
    if weight.sum() < ENOUGH:
        return 1.0
    found = np.cumsum(weight @ (seen[linked] / seen[linked].sum(1)[:, None])) / weight.sum()
    return float(min(1.0, max(LEAST, MARGIN * (int(np.searchsorted(found, TARGET)) + 1) / _BINS)))


def _pairs_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row and the value of each entry of a list column."""
    return np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths())), lists.flatten().to_numpy().astype(np.int64)


def _met(queries: pa.Table, members: pa.Table, threshold: float) -> pa.Table:
    """Counts and a spanning forest of the links between the queries and the members of one block.

    A query meets the members in the cells that it visits. A link counts for the query, and for the member too unless the
    member's own query visits the cell of the first.
    """
    q, m = (np.asarray(t.column("rep")) for t in (queries, members))
    x, y = (_matrix(t.column("unit").combine_chunks()) for t in (queries, members))
    sizes, asking = np.asarray(members.column("size")), np.asarray(queries.column("size"))
    home, own = np.asarray(queries.column("home")).astype(np.int64), np.asarray(members.column("home")).astype(np.int64)
    span = int(max(home.max(initial=0), own.max(initial=0))) + 1
    row, cell = _pairs_of(members.column("cells").combine_chunks())
    known = cell < span  # cells of the members' own queries, as one sorted number each with the member
    returns = row[known] * span + cell[known]
    row, cell = _pairs_of(queries.column("cells").combine_chunks())
    order = np.argsort(cell, kind="stable")
    row, cell = row[order], cell[order]
    by_home = np.argsort(own, kind="stable")
    counts, back, label_q, label_m = np.zeros(len(q), np.int64), np.zeros(len(m), np.int64), q.copy(), m.copy()
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    cells, first = np.unique(own[by_home], return_index=True)
    for c, here in zip(cells.tolist(), np.split(by_home, first[1:])):
        asks = row[np.searchsorted(cell, c) : np.searchsorted(cell, c, "right")]
        for at in range(0, len(asks), 512):
            part = asks[at : at + 512]
            hit = x[part] @ y[here].T >= threshold
            hit &= q[part, None] != m[here][None]
            i, j = np.nonzero(hit)
            i, j = part[i], here[j]
            counts[part] += hit @ sizes[here]
            sought = j * span + home[i]
            found = np.minimum(np.searchsorted(returns, sought), max(0, len(returns) - 1))
            alone = returns[found] != sought if len(returns) else np.ones(len(i), bool)
            np.add.at(back, j[alone], asking[i[alone]])
            pairs.append((i.astype(np.int32), j.astype(np.int32)))
    i, j = (np.concatenate(p) for p in zip(*pairs)) if pairs else (np.zeros(0, np.int32),) * 2
    while len(i):  # least labels spread over the links until they stand; then every node points to its component's
        before = label_q.sum() + label_m.sum()
        np.minimum.at(label_m, j, label_q[i])
        np.minimum.at(label_q, i, label_m[j])
        if label_q.sum() + label_m.sum() == before:
            break
    linked_q, linked_m = np.unique(i), np.unique(j)
    rep = np.concatenate([q, m, q[linked_q], m[linked_m]])
    other = np.concatenate([q, m, label_q[linked_q], label_m[linked_m]])
    n = np.concatenate([counts, back, np.zeros(len(linked_q) + len(linked_m), np.int64)])
    keep = (n > 0) | (rep != other)
    return pa.table({"rep": rep[keep], "other": other[keep], "n": n[keep]})


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding).

    Vectors with a cosine of at least ``threshold`` are linked; a component is everything reachable and named by its
    smallest vec_id, whose row is kept. A vector that is null, empty or zero, or holds a null or a component that isn't
    finite, or whose vec_id is null, links with nothing and is kept. Vectors of different lengths are not compared, however
    many lengths there are. Repeated rows are vectors of their own, also under one vec_id. Other columns are ignored; an
    empty table gives no rows.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(batch.column(1))
            keys = [None if u is None else hashlib.blake2b(u, digest_size=16).digest() for u in units]
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens.blobs(keys), tokens.blobs(units)], names=["vec_id", "key", "unit"])

    needed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = common.stage(needed.mapInArrow(clean, "vec_id long, key binary, unit binary"))
    classes = common.stage(
        rows.filter("key is not null and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("unit").alias("unit"))
    )
    found = common.stage(_links(classes, threshold))
    labels = common.components(found.filter("rep <> other"), "rep", "other")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    named = (
        classes.select("key", "rep", "size").join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    )
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left").withColumn("component_id", F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _counted(rows: DataFrame, per_row: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> dict[tuple[int, int], int]:
    """How often each pair of numbers stands in the rows; counted within batches before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = per_row(batch)
            (a, b), n = np.unique(np.stack([a, b]).astype(np.int64), axis=1, return_counts=True) if len(a) else ((a, b), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b, n)], names=["a", "b", "n"])

    return {(r["a"], r["b"]): r["n"] for r in rows.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}


def _links(classes: DataFrame, threshold: float) -> DataFrame:
    """(rep, other, n): link counts of distinct vectors, and edges that span their components.

    What reaches the driver is the sample, counts by length and cell, and counts by length and row of the grid.
    """
    lengths = classes.groupBy(F.octet_length("unit").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    dims = max(2, lengths[0]["w"] // 8) if lengths else 2
    total = classes.count()
    chosen = classes.orderBy(F.xxhash64("rep"), "rep").limit(FIT_VECTORS).select("unit", "rep").collect()
    raw, names = pa.array([bytes(r[0]) for r in chosen], pa.binary()), np.array([r[1] for r in chosen], np.int64)
    sample, probes = _view(raw, dims), {size: (at, x) for size, at, x in _by_length(raw)}
    index = _Index(sample if len(sample) else np.zeros((1, dims)), int(np.clip(np.sqrt(total / PER_CELL), *CODEWORDS)))
    cells = len(index.books[0]) * index.width

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, _, _ = index.look(_view(batch.column(2), dims))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["rep", "size", "unit", "cell"])

    placed = common.stage(classes.select("rep", "size", "unit").mapInArrow(assign, "rep long, size long, unit binary, cell int"))
    held = _counted(placed.select("unit", "cell"), lambda batch: (np.asarray(pc.binary_length(batch.column(0))), np.asarray(batch.column(1))))
    of_row: dict[tuple[int, int], int] = {}
    full: dict[int, np.ndarray] = {}
    for (size, cell), n in held.items():
        of_row[size, cell // index.width] = of_row.get((size, cell // index.width), 0) + n
        full.setdefault(size, np.zeros(cells, bool))[cell] = True

    exact = 2 - 2 * threshold

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(sample) * _BINS, np.int64)
        _, left, right = index.look(sample)
        for batch in batches:
            rep, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for size, of, units in _by_length(batch.column(1)):
                asking, x = probes.get(size, (np.zeros(0, int), np.zeros((0, size))))
                for at in range(0, len(asking), 512):
                    i, j = np.nonzero(x[at : at + 512] @ units.T >= threshold)
                    i, j = asking[i + at], of[j]
                    others = names[i] != rep[j]
                    i, j = i[others], j[others]
                    passed = left[i, cell[j] // index.width] + right[i, cell[j] % index.width]
                    np.add.at(seen, i * _BINS + np.minimum((passed / exact * _BINS).astype(int), _BINS - 1), 1)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["bin", "n"])

    seen = np.zeros(len(sample) * _BINS, np.int64)
    for r in placed.select("rep", "unit", "cell").mapInArrow(bound, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        seen[r["bin"]] = r["n"]
    seen = seen.reshape(-1, _BINS)
    met = np.ones(len(sample))
    for at, x in probes.values():
        linked = seen[at].sum(1) > 0
        own = x[linked]
        met[at[linked]] = np.concatenate([(own[k : k + 512] @ own.T >= threshold).sum(1) for k in range(0, len(own), 512)] or [np.zeros(0)])
    stop = exact * _share(met, seen) * (1 + 1e-9)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                found: list[np.ndarray] = [np.zeros(0, np.int64)] * piece.num_rows
                for size, of, _ in _by_length(piece.column(2)):
                    for i, seen_ in zip(of.tolist(), index.visits(_view(piece.column(2).take(pa.array(of)), dims), stop, full[8 * size])):
                        found[i] = seen_
                borders = np.concatenate([[0], np.cumsum([len(c) for c in found])])
                lists = tokens.ragged(np.concatenate(found).astype(np.int32), borders, pa.int32())
                yield pa.RecordBatch.from_arrays([*piece.columns, lists], names=["rep", "size", "unit", "cell", "cells"])

    queries = common.stage(placed.mapInArrow(visit, "rep long, size long, unit binary, cell int, cells array<int>"))

    def rows_asked(units: pa.Array, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The query, the row of the grid and the first of its cells there, for each row that a query visits; cells are sorted."""
        of, cell = _pairs_of(lists)
        key = of * (len(index.books[0]) + 1) + cell // index.width
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return of[first], cell[first] // index.width, first

    def asked_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        of, row, _ = rows_asked(batch.column(0), batch.column(1))
        return np.asarray(pc.binary_length(batch.column(0)))[of], row

    asked = _counted(queries.select("unit", "cells"), asked_of)
    # each row's members and queries in so many blocks; a block of members meets every block of queries
    blocks = {k: (-(-n // MEMBERS), -(-asked.get(k, 0) // QUERIES)) for k, n in of_row.items()}
    spread = lambda rep, n: (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n

    def dealt(batch: pa.RecordBatch, at: np.ndarray, row: np.ndarray, cells_: pa.Array, member: bool) -> pa.RecordBatch:
        """A copy of what is at each place for each block of the other side."""
        rep, sizes = batch.column(0).to_numpy()[at], np.asarray(pc.binary_length(batch.column(2)))[at]
        counts = np.array([blocks[k] for k in zip(sizes.tolist(), row.tolist())], np.int64).reshape(-1, 2)
        own = spread(rep, np.maximum(counts[:, 0 if member else 1], 1))
        other = counts[:, 1 if member else 0]
        copy = np.repeat(np.arange(len(at)), other)
        each = np.arange(len(copy)) - np.repeat(np.cumsum(other) - other, other)
        m, q = (own[copy], each) if member else (each, own[copy])
        carried = [c.take(pa.array(at[copy])) for c in batch.columns[:4]]
        columns = [*carried, cells_.take(pa.array(copy)), pa.array(sizes[copy].astype(np.int64)), pa.array(row[copy]), pa.array(m), pa.array(q), pa.array(np.full(len(copy), member))]
        return pa.RecordBatch.from_arrays(columns, names=["rep", "size", "unit", "home", "cells", "bytes", "row", "m", "q", "member"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                piece = batch.slice(at, 200)
                home = piece.column(3).to_numpy().astype(np.int64) // index.width
                yield dealt(piece, np.arange(piece.num_rows), home, piece.column(4), True)
                of, row, first = rows_asked(piece.column(2), piece.column(4))
                values = piece.column(4).flatten().to_numpy()
                yield dealt(piece, of, row, tokens.ragged(values, np.append(first, len(values)), pa.int32()), False)

    schema = "rep long, size long, unit binary, home int, cells array<int>, bytes long, row long, m long, q long, member boolean"
    meeting = queries.mapInArrow(deal, schema)

    def meet(table: pa.Table) -> pa.Table:
        member = table.column("member")
        return _met(table.filter(pc.invert(member)), table.filter(member), threshold)

    return meeting.groupBy("bytes", "row", "m", "q").applyInArrow(meet, "rep long, other long, n long")
