"""Sharding by balanced label propagation.

Documents are a graph: equal texts are neighbours, through one node for each text rather than all pairs. Rows start with
labels that fill the shards' quotas, dealt at random. In each round the labels are joined to the text nodes and counted, and
every text whose rows have several labels asks for one: that of most of its rows, among shards that may take them. Texts are
accepted in a fixed order as long as every shard keeps to its quota once all accepted rows have moved, in and out, with rows
without neighbours giving way; what was rejected asks elsewhere in the next round, where there is room. Each move takes all
links of a text out of the cut, so the cut falls from round to round, and it ends when nothing moves.

Groups of more than a thousandth of all rows, of which there are fewer than a thousand, are placed first, largest first; one
that is larger than any room fills the emptiest shards one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm import common

#: A group is heavy from this share of all rows on.
HEAVY = 1000


def _heavy_plan(groups: list[tuple[str, int, list[int]]], room: list[int]) -> dict[str, list[tuple[int, int]]]:
    """(shard, rows) for each heavy group, one pair if it stays whole; room is used up."""
    plan: dict[str, list[tuple[int, int]]] = {}
    for link, copies, votes in sorted(groups, key=lambda g: (-g[1], g[0])):
        fits = [s for s in range(len(room)) if room[s] >= copies]
        order = [max(fits, key=lambda s: (votes[s], room[s], -s))] if fits else sorted(range(len(room)), key=lambda s: (-room[s], s))
        left, parts = copies, []
        for s in order:
            if take := min(left, room[s]):
                parts.append((s, take))
                room[s] -= take
                left -= take
        plan[link] = parts
    return plan


def _by_ranges(number: Column, parts: list[tuple[int, int]]) -> Column:
    """The shard of a number, where each shard takes so many numbers in turn."""
    out, end = F.lit(None).cast("long"), sum(n for _, n in parts)
    for shard, n in reversed(parts):
        out = F.when(number < end, F.lit(shard).cast("long")).otherwise(out)
        end -= n
    return F.when(number >= end, out)


def _counted(labels: DataFrame, n_shards: int) -> DataFrame:
    """(link, copies, votes): how many rows of each text have each label."""
    votes = F.array(*[F.coalesce(F.sum(F.when(F.col("shard") == s, F.col("n"))), F.lit(0)) for s in range(n_shards)])
    return labels.groupBy("link").agg(F.sum("n").alias("copies"), votes.alias("votes"))


def cut_of(labels: DataFrame) -> int:
    """Pairs of equal texts in different shards."""
    sums = labels.groupBy("link").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return int(sums.agg(F.coalesce(F.sum(F.expr("(n * n - same) div 2").cast("decimal(38,0)")), F.lit(0))).first()[0])


def _asked(votes: DataFrame, free: list[int], closed: set[int]) -> DataFrame:
    """votes with target and need: the shard with most votes, unless it is closed to as many rows; ties go by a hash."""
    need = lambda s: F.col("copies") - F.col("votes")[s]
    open_ = lambda s: F.lit(True) if s not in closed else need(s) <= free[s]
    options = [F.when(open_(s), F.struct(F.col("votes")[s].alias("votes"), F.xxhash64("link", F.lit(s)).alias("tie"), F.lit(s).alias("shard"))) for s in range(len(free))]
    asked = votes.filter(F.array_max("votes") < F.col("copies")).withColumn("target", F.greatest(*options)["shard"]).filter("target is not null")
    return asked.withColumn("need", F.col("copies") - F.element_at("votes", F.col("target") + 1))


def _accepted(asking: DataFrame, free: list[int]) -> tuple[list[int], list[list[int]]]:
    """For each shard the need up to which it takes texts, in their order, and the rows that then move from one to another.

    All are taken at first; as long as a shard would have too many rows, it takes so many fewer, which only ever lowers the
    limits.
    """
    n = len(free)
    limits = [1 << 62] * n
    while True:
        limit = F.element_at(F.array(*[F.lit(x).cast("long") for x in limits]), F.col("target") + 1)
        moved = asking.filter(F.col("_before") + F.col("need") <= limit).groupBy("target").agg(*[F.sum(F.col("votes")[a]).alias(f"v{a}") for a in range(n)])
        flow = [[0] * n for _ in range(n)]
        for r in moved.collect():
            for a in range(n):
                if a != r["target"]:
                    flow[a][r["target"]] = r[f"v{a}"]
        into, out = [sum(flow[a][b] for a in range(n)) for b in range(n)], [sum(flow[b]) for b in range(n)]
        over = [into[b] - out[b] - free[b] for b in range(n)]
        if max(over) <= 0:
            return limits, flow
        limits = [min(limits[b], into[b] - over[b]) if over[b] > 0 else limits[b] for b in range(n)]


def propagated(labels: DataFrame, free: list[int]) -> tuple[DataFrame, list[int], list[int]]:
    """(labels, free, cuts): the labels (link, shard, n) after all rounds, the rows that each shard still takes, and the cut before and after each round."""
    labels, cuts, closed = common.stage(labels), [], set()
    while True:
        cuts.append(cut_of(labels))
        votes = common.stage(_counted(labels, len(free)))
        asking = _asked(votes, free, closed)
        n = asking.count()
        if not n:
            return labels, free, cuts
        asking = common.stage(common.offsets(asking, ["target"], ["link"], "need", "_before", n))
        limits, flow = _accepted(asking, free)
        limit = F.element_at(F.array(*[F.lit(x).cast("long") for x in limits]), F.col("target") + 1)
        judged = asking.select("link", "copies", "target", (F.col("_before") + F.col("need") <= limit).alias("_in"))
        rejected = {r["target"] for r in judged.filter(~F.col("_in")).select("target").distinct().collect()}
        if not any(map(any, flow)) and rejected <= closed:
            return labels, free, cuts
        moved = judged.filter("_in")
        labels = common.stage(labels.join(moved.select("link"), "link", "left_anti").unionByName(moved.select("link", F.col("target").alias("shard"), F.col("copies").alias("n"))))
        free = [f - sum(row[b] for row in flow) + sum(flow[b]) for b, f in enumerate(free)]
        closed |= rejected


def sharded(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs (doc_id, text), under the law 'rows'.

    Shards hold numbers of rows at most one apart; slot counts a shard's rows from 0 without gaps; grown_shard is null, as
    the law has no use for it. size is the text's UTF-8 bytes plus 1. Groups are equal texts; a null text has the bytes of
    the empty one and is in one group with it. Repeated rows and rows with null ids are rows of their own; however they are
    partitioned, reruns agree. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("link"),
    )
    # equal rows are numbered as one and then listed one by one
    same = common.stage(base.groupBy(*base.columns).agg(F.count("*").alias("_n")))
    n_same, total = same.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    numbered = common.offsets(same, [], ["link", "doc_id"], "_n", "_at", n_same)
    listed = common.repeated(numbered, "_n", "_copy")
    rows = common.stage(listed.withColumn("at", F.col("_at") + F.col("_copy")).drop("_at", "_copy"))
    first_votes = F.array(*[F.count(F.when(F.col("at") % n_shards == s, 1)) for s in range(n_shards)])
    groups = common.stage(rows.groupBy("link").agg(F.count("*").alias("copies"), first_votes.alias("votes")).filter("copies > 1"))
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    heavy = F.col("copies") > max(1, total // HEAVY)  # fewer than HEAVY groups of that size add up to all rows
    plan = _heavy_plan([(r["link"], r["copies"], r["votes"]) for r in groups.filter(heavy).collect()], room)
    names = ["doc_id", "size", "text_crc32", "at", "shard"]
    linked = rows.join(groups.select("link", "copies"), "link", "left").withColumn("_heavy", F.col("link").isin(list(plan)) if plan else F.lit(False))
    # what isn't heavy starts with labels that fill the room
    dealt = common.offsets(common.stage(linked.filter("not _heavy")), [], ["at"], None, "_k", total)
    dealt = common.stage(dealt.withColumn("shard", _by_ranges(F.col("_k"), [(s, r) for s, r in enumerate(room) if r]).cast("int")).drop("_k", "_heavy"))
    begun = dealt.filter("copies is not null").groupBy("link", "shard").agg(F.count("*").alias("n"))
    by_shard = {r["shard"]: r["n"] for r in begun.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    labels, free, _ = propagated(begun, [room[s] - by_shard.get(s, 0) for s in range(n_shards)])

    ends = labels.groupBy("link").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("_parts"))
    with_ends = dealt.filter("copies is not null").drop("shard").join(ends.hint("merge"), "link")
    parts = [with_ends.filter(F.size("_parts") == 1).withColumn("shard", F.get("_parts", F.lit(0))["shard"].cast("long")).select(names)]
    torn = common.offsets(common.stage(with_ends.filter(F.size("_parts") > 1)), ["link"], ["at"], None, "_k", total)
    walk = F.aggregate("_parts", F.struct(F.lit(0).cast("long").alias("end"), F.lit(None).cast("int").alias("shard")), lambda acc, p: F.struct(
        (acc["end"] + p["n"]).alias("end"), F.coalesce(acc["shard"], F.when(F.col("_k") < acc["end"] + p["n"], p["shard"])).alias("shard"),
    ))
    parts.append(torn.withColumn("shard", walk["shard"].cast("long")).select(names))
    if plan:
        k = common.offsets(common.stage(linked.filter("_heavy")), ["link"], ["at"], None, "_k", total)
        shard = F.lit(None).cast("long")
        for link, of in plan.items():
            shard = F.when(F.col("link") == link, _by_ranges(F.col("_k"), of)).otherwise(shard)
        parts.append(k.withColumn("shard", shard).select(names))
    rest = common.offsets(common.stage(dealt.filter("copies is null").drop("shard")), [], ["at"], None, "_k", total)
    out = rest.withColumn("shard", _by_ranges(F.col("_k"), [(s, r) for s, r in enumerate(free) if r])).select(names)
    for part in parts:
        out = out.unionByName(part)
    out = common.offsets(common.stage(out), ["shard"], ["at"], None, "slot", total)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
