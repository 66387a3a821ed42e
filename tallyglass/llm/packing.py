"""Best-fit packing of documents into fixed-size training sequences, with conflicts.

Pieces are dealt by a hash of their doc_id and text into groups of bounded size, and each group is packed on its own, longest first. Open bins stand
in the order of their residual space; the search starts at the first that the piece fits in and goes on to successors
until one has no conflict, so the tightest compatible bin takes it. A bin carries bitmaps: which duplicate clusters it
holds (a second member never joins) and, plane by plane, which sources it holds once, twice and so on.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm import common

CAPACITY, PER_SOURCE, GROUP_ROWS = 2048, 3, 4096
_BINS = 1 << 20


def pack_group(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[int]:
    """A bin number for each piece, in the order given; every size is from 1 to capacity."""
    open_: list[tuple[int, int]] = []
    planes: list[list[int]] = []
    held: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        of_source, of_cluster = 1 << source, (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(open_, (size, -1))
        while at < len(open_) and (held[open_[at][1]] & of_cluster or planes[open_[at][1]][-1] & of_source):
            at += 1
        if at == len(open_):
            residual, chosen = capacity, len(held)
            held.append(0)
            planes.append([0] * per_source)
        else:
            residual, chosen = open_.pop(at)
        for plane, bits in enumerate(planes[chosen]):
            if not bits & of_source:
                planes[chosen][plane] |= of_source
                break
        held[chosen] |= of_cluster
        if residual > size:
            insort(open_, (residual - size, chosen))
        out.append(chosen)
    return out


def _codes(values: pa.ChunkedArray) -> list[int]:
    """A small number for each distinct value."""
    return values.combine_chunks().dictionary_encode("encode").indices.to_pylist() if len(values) else []


def packed(
    docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, with_text: bool = False, cluster: Column | None = None, clusters: DataFrame | None = None
) -> DataFrame:
    """(doc_id, source, piece, start_word, n_words, bin_id, position) for every row of docs, in pieces.

    A text of more than ``capacity`` words is cut: its full pieces are bins of their own, and the rest is packed. In a bin
    are at most ``per_source`` pieces of one source (null is one) and one of each duplicate cluster. A row's cluster is that
    of its doc_id in ``clusters`` (doc_id, component_id: what near-duplicate detection returns), else the value of the
    column ``cluster``, else a hash of its text. position orders a bin's pieces from 0. A null or empty text is one piece of
    no words, in no bin. Repeated rows are packed each, in different bins. ``with_text`` adds the words of the piece. Other
    columns are ignored; an empty table gives no rows. Groups have about GROUP_ROWS pieces, whatever ids, texts or clusters
    repeat. Which rows meet in one follows from their doc_id and text, whatever the order and partitioning of the input.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    number = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)).cast("long")
    own = F.xxhash64("text")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), own.alias("_text"),
        (own if cluster is None else cluster.cast("long")).alias("cluster"), *([F.col("text").cast("string").alias("text")] if with_text else []),
    )
    # a row is its doc_id and text; copies are told apart only where they would crowd a group, by numbers from 0
    key = ["doc_id", "_text"]
    counts = base.groupBy(*key).agg(F.count("*").alias("n"), F.sum(number).alias("pieces"))
    n_pieces, most = counts.agg(F.sum("pieces"), F.max("n")).first()
    n_pieces, most = n_pieces or 0, most or 0
    identity = lambda copy: F.xxhash64(*key, copy)
    if most > GROUP_ROWS // 4:
        crowded = common.stage(counts.filter(F.col("n") > GROUP_ROWS // 4).select(*[F.col(c).alias(f"_c{c}") for c in key]))
        same = F.col("doc_id").eqNullSafe(F.col("_cdoc_id")) & F.col("_text").eqNullSafe(F.col("_c_text"))
        few = base.join(crowded, same, "left_anti").withColumn("_row", identity(F.lit(0).cast("long")))
        many = base.join(crowded, same, "left_semi").groupBy(*base.columns).agg(F.count("*").alias("_n"))
        base = few.unionByName(common.repeated(many, "_n", "_copy").withColumn("_row", identity(F.col("_copy"))).drop("_copy"))
    else:
        base = base.withColumn("_row", identity(F.lit(0).cast("long")))
    base = base.drop("_text")
    n_groups = max(1, n_pieces // GROUP_ROWS)
    if clusters is not None:
        # rows of one doc_id count as one cluster here; its components are hashed apart from other clusters' values
        known = clusters.filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("_known"))
        base = base.join(known.hint("merge"), "doc_id", "left").withColumn("cluster", F.coalesce(F.xxhash64("_known", F.lit(1)), "cluster")).drop("_known")
    if with_text:  # split once a row, before it becomes pieces
        base = base.withColumn("words", common.words("text")).drop("text")
    pieces = base.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), number - 1)))
    pieces = pieces.withColumn("start_word", F.col("piece") * capacity).withColumn("n_words", F.least(F.lit(capacity), F.col("size") - F.col("start_word")))
    if with_text:
        part = F.slice("words", (F.col("start_word") + 1).cast("int"), F.greatest(F.col("n_words"), F.lit(0)).cast("int"))
        pieces = pieces.withColumn("text", F.array_join(part, " ")).drop("words")
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("_row", "piece"), F.lit(n_groups))).drop("size")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending"), ("source", "ascending"), ("_row", "ascending")])
        n = np.asarray(table.column("n_words"))
        some = int((n > 0).sum())
        clusters = np.array(_codes(table.column("cluster").slice(0, some)), np.int64)
        alone = np.bincount(clusters, minlength=1)[clusters] == 1
        clusters[alone] = -1
        distinct = {c: i for i, c in enumerate(np.unique(clusters[~alone]).tolist())}
        bins = pack_group(n[:some].tolist(), _codes(table.column("source").slice(0, some)), [distinct.get(c, -1) for c in clusters.tolist()], capacity, per_source)
        seen: dict[int, int] = {}
        position = []
        for b in bins:
            position.append(seen.get(b, 0))
            seen[b] = position[-1] + 1
        base_id = table.column("group")[0].as_py() * _BINS if len(table) else 0
        none = [None] * (len(table) - some)
        ids = pa.array([base_id + b for b in bins] + none, pa.int64())
        keep = table.drop_columns(["group", "cluster", "_row"])
        return keep.append_column("bin_id", ids).append_column("position", pa.array(position + none, pa.int64()))

    names = "doc_id long, source string, piece long, start_word long, n_words long" + (", text string" if with_text else "")
    ordered = pieces.select("doc_id", "source", "piece", "start_word", "n_words", *(["text"] if with_text else []), "cluster", "_row", "group")
    return ordered.groupBy("group").applyInArrow(run, f"{names}, bin_id long, position long")
