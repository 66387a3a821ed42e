"""Mixing sources to target weights with blocks, multinomial shard draws and index permutations.

The words of a source form one stream, cut into blocks of fixed length. How many blocks of each source the mix takes follows
from the targets; output shards are halved again and again, and each half draws its counts of sources at random, binomially
with the rest that is missing or too many drawn multinomially, so shards vary as draws without putting back do while the
sums over all shards are exact, at every size. Slots of a source are numbered through the shards, and number k of a pass
over the source reads block perm(k) of a pseudorandom permutation of the source's block numbers, a new one for each pass.
Blocks are then joined with documents by index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass.llm import common, tokens

#: Words of a block, blocks of an output shard, the weights by rank of a source, and how often a source may be repeated.
BLOCK, SHARD, WEIGHTS, REPEATS = 32, 4096, (5, 2, 1), 3
_U = np.uint64
_WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, source, size) for every row, and what is asked for besides."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), *more)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, rank, source_size, target): shares of all words by weight, none above repeats times its source's size.

    Sources rank by code point, null last. One row per source; in the order of how soon they are full, a source is full if
    its fair share of what those before it leave is more than it may take.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    every, order = Window.partitionBy(), Window.orderBy("fills", "rank").rowsBetween(Window.unboundedPreceding, -1)
    filling = (
        ranked.withColumn("w", weight).withColumn("most", F.lit(repeats) * F.col("source_size")).withColumn("fills", F.col("most") / F.col("w"))
        .withColumn("all", F.sum("source_size").over(every)).withColumn("left", F.col("all") - F.coalesce(F.sum("most").over(order), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(order), F.lit(0.0)))
        .withColumn("full", F.col("fills") <= F.col("left") / F.col("w_left"))
    )
    level = F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0))
    share = level * F.col("w") / F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    return filling.select("source", "rank", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(share).alias("target"))


def _permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where a pseudorandom permutation of 0 .. n - 1 takes each index: a Feistel network that walks until below n."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, out, todo = _U((1 << half) - 1), index.astype(_U), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> _U(half), out[todo] & mask
        for r in range(4):
            left, right = right, left ^ (tokens.mix(right + _U((seed * 4 + r) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & mask)
        out[todo] = (left << _U(half)) | right
        todo = todo[out[todo] >= _U(n)]
    return out.astype(np.int64)


def _split(counts: np.ndarray, share: int, whole: int, seed: list[int]) -> np.ndarray:
    """How much of each count falls to the first ``share`` of ``whole`` equal places; its sum is ``share``.

    Each source is drawn binomially. What the sum then lacks is drawn from what is left of the sources, what it has too much
    from what they got; both are of the order of the sum's root. Variances are those of drawing without putting back.
    """
    random = np.random.default_rng(seed)
    part = random.binomial(counts, share / whole) if whole else np.zeros_like(counts)
    while missing := share - int(part.sum()):
        room = counts - part if missing > 0 else part
        part = part + int(np.sign(missing)) * np.minimum(room, random.multinomial(abs(missing), room / room.sum()))
    return part


def _drawn(counts: np.ndarray, shard: int, n_shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's counts of sources and those of all shards before it, by halving the shards down to this one."""
    before, low, high = np.zeros_like(counts), 0, n_shards
    while high - low > 1:
        middle = (low + high) // 2
        first = min(int(counts.sum()), (middle - low) * SHARD)
        left = _split(counts, first, int(counts.sum()), [seed, low, high])
        if shard < middle:
            counts, high = left, middle
        else:
            counts, before, low = counts - left, before + left, middle
    return counts, before


def drawn_blocks(plan: DataFrame, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """(shard, slot, rank, block): the mix as a list of blocks; plan is what targets() returns.

    The plan (a row per source) reaches the driver; shards are drawn on the executors.
    """
    rows = plan.filter("source_size > 0").orderBy("rank").collect()
    ranks, sizes = np.array([r["rank"] for r in rows], np.int64), np.array([r["source_size"] for r in rows], np.int64)
    blocks = -(-sizes // block)
    passes = np.array([int(r["target"] // r["source_size"]) for r in rows], np.int64)
    rest = np.array([round((r["target"] - p * r["source_size"]) / block) for r, p in zip(rows, passes)], np.int64)
    slots = passes * blocks + np.minimum(rest, blocks)
    n_shards = int(-(-slots.sum() // SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts, before = _drawn(slots, shard, n_shards, seed)
                rank, found = np.repeat(np.arange(len(counts)), counts), np.empty(int(counts.sum()), np.int64)
                for i in np.flatnonzero(counts):
                    k = before[i] + np.arange(counts[i])
                    for turn in np.unique(k // blocks[i]):
                        at = k // blocks[i] == turn
                        found[np.flatnonzero(rank == i)[at]] = _permuted(k[at] % blocks[i], int(blocks[i]), int(ranks[i] * 8 + turn + seed))
                columns = [pa.array(np.full(len(rank), shard)), pa.array(np.arange(len(rank))), pa.array(ranks[rank].astype(np.int64)), pa.array(found)]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "slot", "rank", "block"])

    spark = plan.sparkSession
    return spark.range(0, n_shards, 1, max(1, n_shards // 8)).mapInArrow(run, "shard long, slot long, rank long, block long")


def _pieces(docs: DataFrame, weights: tuple[float, ...], repeats: int, block: int, seed: int, row: tuple[str, ...] = ()) -> DataFrame:
    """For every row its sizes and target, its place in the source's stream, and how often each of its pieces is taken.

    Columns of ``row`` are kept; they tell rows of one doc_id and size apart. Without them, equal rows are placed as one and
    then listed one by one, so however many there are, no group of rows is large.
    """
    # rows without a doc_id are dealt by their texts, or all of them would be one group
    place = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("place")
    sizes = common.stage(sized(docs, place, *row))
    plan = common.stage(targets(sizes, weights, repeats))
    if row:
        placed = common.offsets(sizes, ["source"], ["place", *row], "size", "start", sizes.count())
    else:
        same = common.stage(sizes.groupBy(*sizes.columns).agg(F.count("*").alias("_n")).withColumn("_all", F.col("_n") * F.col("size")))
        placed = common.offsets(same, ["source"], ["place", "doc_id", "size"], "_all", "start", same.count())
        again = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
        placed = placed.withColumn("_k", again).withColumn("start", F.col("start") + F.col("_k") * F.col("size")).drop("_n", "_all", "_k")
    known = placed.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "p.rank", "p.source_size", "p.target")
    end = F.col("start") + F.col("size")
    covers = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block)))
    pieces = known.select("*", F.explode_outer(covers).alias("block"))
    uses = drawn_blocks(plan, seed, block).groupBy("rank", "block").agg(F.count("*").alias("uses"))
    low, high = F.greatest("start", F.col("block") * block) - F.col("start"), F.least(end, (F.col("block") + 1) * block) - F.col("start")
    # the plan of a generated table looks small to the optimizer, but blocks grow with the input: never broadcast them
    return pieces.join(uses.hint("merge"), ["rank", "block"], "left").withColumns({"uses": F.coalesce("uses", F.lit(0)), "low": low, "high": high})


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs (doc_id, text, source).

    Sizes are in words, none for a null or empty text; a null source is a source of its own. taken counts the words that
    the mix takes from the row, repeats included: each source's come to its target but for half a block, and no row gives
    more than ``repeats`` times its size. The seed decides all draws. Repeated rows are mixed each; rows without words give
    nothing. Other columns are ignored, and an empty table gives no rows.
    """
    pieces = _pieces(docs, weights, repeats, block, seed)
    taken = F.coalesce(F.sum((F.col("high") - F.col("low")) * F.col("uses")), F.lit(0)).cast("long")
    rows = ["doc_id", "source", "size", "start", "source_size", "target"]
    # rows without words share their start with others; they are listed apart, one for one
    some = pieces.filter("size > 0").groupBy(*rows).agg(taken.alias("taken"))
    none = pieces.filter("size = 0").select(*rows, F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none).select("doc_id", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """The mix as rows like those of docs: a text as often as all its blocks are taken, and once the words of blocks taken
    once more, joined by one space.

    A row of which nothing is taken goes, and so do null and empty texts; n_chars, if there, follows the text, other columns
    are carried. Rows with no doc_id or a repeated one are mixed each. An empty table gives no rows.
    """
    numbered = common.stage(docs.withColumn("_mix_row", F.monotonically_increasing_id()))
    pieces = _pieces(numbered, weights, repeats, block, seed, ("_mix_row",)).filter("size > 0")
    lists = (
        pieces.groupBy("_mix_row").agg(F.min("uses").alias("_mix_whole"), F.array_sort(F.collect_list(F.struct("low", "high", "uses"))).alias("_mix_parts"))
        .filter("_mix_whole > 0 or exists(_mix_parts, p -> p.uses > 0)")
    )
    joined = numbered.join(lists, "_mix_row")
    some = F.filter("_mix_parts", lambda p: p["uses"] > F.col("_mix_whole"))
    # the words are bound once a row; a column of them would be split again for every part
    parts = lambda w: F.flatten(F.transform(some, lambda p: F.slice(w, (p["low"] + 1).cast("int"), (p["high"] - p["low"]).cast("int"))))
    cut = F.array_join(F.get(F.transform(F.array(common.words("text")), parts), F.lit(0)), " ")
    again = F.when(F.size(some) > 0, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    texts = F.concat(F.array_repeat(F.col("text"), F.col("_mix_whole").cast("int")), F.transform(again, lambda _: F.col("_mix_cut")))
    out = joined.withColumn("_mix_cut", F.when(F.size(some) > 0, cut)).withColumn("_mix_text", F.explode(texts))
    columns = {"text": F.col("_mix_text"), "n_chars": F.length("_mix_text").cast("long")}
    return out.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
