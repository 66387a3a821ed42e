"""Near-duplicate documents by min-max hashing of word shingles.

1. Every text becomes its set of hashed shingles. Under each of 32 permutations the smallest *and* the largest hash are
   kept: 64 signature values from 32 evaluations. Sixteen bands of four values (eight of minima, eight of maxima, always
   from four different permutations) meet for a pair of similarity 0.85 with probability 1 - 7e-6.
2. Texts with one and the same set are one class (a fingerprint of the set); from here on a class is one node.
3. In each band bucket the classes are compared with the oldest (of the smallest doc_id, unless said otherwise), which
   copies tend to be copies of, on their full sets. What links joins a component. Where a bucket still holds several
   components, its classes are compared with the most central one too: the one of whose shingles most are also others'.
4. Buckets that hold several components even then get the remaining pairs of different components, by a prefix filter: with
   each set ordered by how many classes have a shingle, rare ones first, two similar sets share a shingle in front, at places
   that bound the similarity exactly. Pairs within the bound are compared, again on full sets. No link is given up.

Cost: a bucket's comparisons with two leaders are linear. In step 4 only classes outside a shingle's largest component ask the
classes that have it in front; both sides are cut into blocks of at most about BLOCK classes, so that no task holds all that
have a shingle. Near copies of a text that is not there itself, of which each is just not similar to the others, still meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass.llm import common, tokens

PERMUTATIONS, ROWS = 32, 4
#: Classes of a bucket that meet others in one task.
BLOCK = 512
_U = np.uint64


def _shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of every text end to end, each text's sorted, and their borders."""
    data, offsets = tokens.text_buffer(column)
    starts, ends, first = tokens.word_spans(data, offsets)
    hashed = tokens.hash_words(data, starts, ends, lower=True)
    windows, n_words = tokens.hash_windows(hashed, width), np.diff(first)
    parts = []
    for i, n in enumerate(n_words):
        if n >= width:
            parts.append(tokens.distinct(windows[first[i] : first[i] + n - width + 1]))
        elif n:
            parts.append(tokens.hash_windows(hashed[first[i] : first[i] + n], int(n)) ^ _U(n))
        else:
            parts.append(np.zeros(0, _U))
    borders = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.concatenate([*parts, np.zeros(0, _U)]), borders


def _band_keys(shingles: np.ndarray, borders: np.ndarray, permutations: int) -> np.ndarray:
    """Per non-empty text, one key for each band."""
    full = np.flatnonzero(np.diff(borders))
    at = borders[full]
    low, high = np.empty((permutations, len(full)), _U), np.empty((permutations, len(full)), _U)
    for k in range(permutations):
        permuted = tokens.mix(shingles * (tokens.mix(np.array([k + 1], _U) * _U(0x2545F4914F6CDD1D)) | _U(1)))
        low[k], high[k] = np.minimum.reduceat(permuted, at), np.maximum.reduceat(permuted, at)
    keys = []
    for side, values in enumerate((low, high)):
        for band in range(permutations // ROWS):
            key = np.full(len(full), side * 1000 + band + 1, _U)
            for row in range(ROWS):
                key = tokens.mix(key * _U(31) + values[band * ROWS + row])
            keys.append(key)
    return np.stack(keys, 1)


def signatures(docs: DataFrame, width: int = 5, permutations: int = PERMUTATIONS, oldest: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, age, n_shingles, set_sum, set_xor, bands) per row; bands is empty for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tokens.slices(batch):
                shingles, borders = _shingle_sets(piece.column(1), width)
                sizes = np.diff(borders)
                full = sizes > 0
                total, odd = np.zeros(len(sizes), _U), np.zeros(len(sizes), _U)
                keys = np.zeros((0, 2 * permutations // ROWS), _U)
                if full.any():
                    again = tokens.mix(shingles + _U(77))
                    total[full] = np.add.reduceat(again, borders[:-1][full])
                    odd[full] = np.bitwise_xor.reduceat(shingles, borders[:-1][full])
                    keys = _band_keys(shingles, borders, permutations)
                lengths = np.concatenate([[0], np.cumsum(full * keys.shape[1])])
                bands = tokens.ragged(keys.ravel().view(np.int64), lengths, pa.int64())
                columns = [piece.column(0), piece.column(2), piece.column(3), pa.array(sizes, pa.int64()), pa.array(total.view(np.int64)), pa.array(odd.view(np.int64)), bands]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "age", "n_shingles", "set_sum", "set_xor", "bands"])

    return _texts(docs, F.col(oldest).cast("long").alias("age")).mapInArrow(run, "doc_id long, text_key long, age long, n_shingles long, set_sum long, set_xor long, bands array<long>")


def _texts(docs: DataFrame, *more: F.Column) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"), *more)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(rep, shingles) with the sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tokens.slices(batch):
                shingles, borders = _shingle_sets(piece.column(1), width)
                raw = shingles.tobytes()
                sets = tokens.blobs([raw[8 * borders[i] : 8 * borders[i + 1]] for i in range(piece.num_rows)])
                yield pa.RecordBatch.from_arrays([piece.column(0), sets], names=["rep", "shingles"])

    return docs.mapInArrow(run, "rep long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection reaches percent * union, compared on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_buffer(), _U), np.frombuffer(right.as_buffer(), _U)
                small, big = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(big, small), len(big) - 1)
                both = int((big[at] == small).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b"))
    right = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, rep, n, bands, component) of the buckets that hold several components."""
    labelled = buckets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    several = labelled.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo < _hi").select("key")
    return labelled.join(several, "key").select("key", "rep", "n", "bands", "component")


def _shared(sets: DataFrame, involved: DataFrame) -> DataFrame:
    """(rep, shingle, df): the shingles that several of some classes have, with the number of classes."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                sizes = np.array([len(x.as_buffer()) // 8 for x in piece.column(1)])
                values = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in piece.column(1)])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(piece.column(0).to_numpy(), sizes)), pa.array(values)], names=["rep", "shingle"])

    rows = sets.join(involved, "rep").mapInArrow(spread, "rep long, shingle long")
    several = rows.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    return rows.join(several, "shingle").select("rep", "shingle", "df")


def _with_central(mixed: DataFrame, shared: DataFrame) -> DataFrame:
    """Pairs of each bucket's classes with its most central one, of which the largest part is shared with other classes."""
    own = shared.groupBy("rep").agg(F.count("*").alias("_shared"))
    rows = mixed.select("key", "rep", "n", "component").join(own, "rep", "left").withColumn("_lone", 1 - F.coalesce("_shared", F.lit(0)) / F.col("n"))
    central = rows.groupBy("key").agg(F.min(F.struct("_lone", "rep", "component")).alias("_c")).select("key", F.col("_c.rep").alias("leader"), F.col("_c.component").alias("_of"))
    met = rows.select("key", "rep", "component").join(central, "key").filter("component <> _of")
    return met.select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct()


def _needed(a: str, b: str, percent: int) -> F.Column:
    """Shingles that sets of so many must share to reach the similarity."""
    return F.expr(f"({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent}")


def _remaining(mixed: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in one bucket that can still be similar.

    Each class orders its shingles by how many classes have them, those of its own first. Of two sets that share enough, the
    first shared shingle in that order can't stand further back in either than what is left behind it suffices for. So only
    classes meet that hold one shingle in front; sets that differ by rare shingles don't meet on the frequent ones.
    """
    classes = mixed.groupBy("rep").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("component").alias("component"))
    by_rep = Window.partitionBy("rep")
    placed = shared.join(classes.select("rep", "n"), "rep").withColumn("_of", F.count("*").over(by_rep)).withColumn("_at", F.row_number().over(by_rep.orderBy("df", "shingle")))
    front = placed.withColumn("pos", F.col("n") - F.col("_of") + F.col("_at")).filter(F.col("pos") <= F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1)
    rows = front.select("rep", F.col("shingle").alias("key"), "pos").join(classes, "rep")
    # how many classes of a shingle ask and answer, and its largest component, whose classes needn't ask
    by_component = rows.groupBy("key", "component").agg(F.count("*").alias("_c"))
    keys = by_component.groupBy("key").agg(F.sum("_c").alias("_all"), F.max(F.struct("_c", "component"))["component"].alias("_largest"), F.max("_c").alias("_most")).filter("_all > _most")
    known = common.stage(rows.join(keys, "key"))
    ask, answer = F.ceil((F.col("_all") - F.col("_most")) / BLOCK).cast("int"), F.ceil(F.col("_all") / BLOCK).cast("int")
    block = lambda n: F.pmod(F.xxhash64("rep", F.lit(5)), n).cast("int")
    asks = F.col("component") != F.col("_largest")
    carried = ["key", "rep", "n", "pos", "component", "bands"]
    x = known.filter(asks).select(*carried, block(ask).alias("i"), F.explode(F.sequence(F.lit(0), answer - 1)).alias("j")).alias("x")
    y = known.select(*carried, asks.alias("asks"), F.explode(F.sequence(F.lit(0), ask - 1)).alias("i"), block(answer).alias("j")).alias("y")
    behind = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) + 1
    on = (
        (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
        & (F.col("x.component") != F.col("y.component")) & (~F.col("y.asks") | (F.col("x.rep") < F.col("y.rep")))
        & (behind >= _needed("x.n", "y.n", percent)) & F.exists(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), lambda same: same)
    )
    return x.join(y, on).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, permutations: int = PERMUTATIONS, oldest: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Rows are linked when their shingle sets reach ``percent`` per cent of similarity; a component is everything reachable
    by links, named by its smallest doc_id, which is the row kept. A null or empty text, or one of white space only, has
    no shingles, links with nothing and is kept. A text of fewer than ``width`` words is one shingle. Rows repeated with
    one doc_id stay repeated; different texts under one doc_id are compared each. Rows with a null doc_id take part, but
    never name a component unless all of it has none; such rows are all kept. Other columns of docs are ignored. An empty
    table gives no rows. ``oldest`` names the number whose smallest value leads a bucket; it changes the work, not the result.
    """
    rows = common.stage(signatures(docs, width, permutations, oldest))
    fingerprint = ["n_shingles", "set_sum", "set_xor"]
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    # a class has a number of its own, which is fixed once it is written
    classes = common.stage(
        rows.filter("n_shingles > 0").groupBy(*fingerprint).agg(one.alias("one"), F.min("age").alias("age"), F.first("bands").alias("bands"))
        .select(*fingerprint, "bands", "age", F.col("one.doc_id").alias("least"), F.col("one.text_key").alias("text_key"), F.monotonically_increasing_id().alias("rep"))
    )
    spread = classes.select("rep", "age", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key"))
    first = F.min(F.struct(F.col("age").isNull().alias("none"), "age", "rep"))["rep"]
    leaders = spread.groupBy("key").agg(first.alias("leader"), F.count("*").alias("_n")).filter("_n > 1").select("key", "leader")
    buckets = common.stage(spread.drop("age").join(leaders, "key"))
    needed = classes.join(buckets.select("rep").distinct(), "rep").select("rep", F.col("least").alias("doc_id"), "text_key")
    texts = _texts(docs.filter("text is not null")).alias("t")
    # the same join at every size: what is needed grows with the input
    found = texts.join(needed.alias("c").hint("merge"), F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.text_key") == F.col("c.text_key")))
    sets = common.stage(_sets(found.select("c.rep", "t.text"), width).dropDuplicates(["rep"]))
    pairs = buckets.filter("rep <> leader").select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct()
    links = common.cut(_verified(pairs, sets, percent))
    banded = buckets.join(classes.select("rep", "bands"), "rep")
    labels = common.components(links, "a", "b")
    mixed = common.stage(_mixed(banded, labels))
    if not mixed.isEmpty():
        shared = common.stage(_shared(sets, mixed.select("rep").distinct()))
        links = links.unionByName(common.cut(_verified(_with_central(mixed, shared), sets, percent)))
        labels = common.components(links, "a", "b")
        still = common.stage(_mixed(mixed.select("key", "rep", "n", "bands"), labels))
        links = links.unionByName(common.cut(_verified(_remaining(still, shared, percent), sets, percent)))
        labels = common.components(links, "a", "b")
    linked = common.stage(classes.select("rep", "least").join(labels, classes.rep == labels.node).select("rep", "least", "component"))
    names = linked.groupBy("component").agg(F.min("least").alias("name"))
    named = linked.join(names, "component").select("rep", "name")
    of_class = classes.join(named, "rep", "left").select(*fingerprint, F.coalesce("name", "least").alias("component_id"))
    out = rows.select("doc_id", *fingerprint).join(of_class, fingerprint, "left")
    # without words, a row is its own component
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))
