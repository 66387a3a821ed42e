"""How far back each use of a cached entry lies, and so what a cache of any capacity would have hit.

In a cache that evicts the least recently used entry, a use is a hit exactly if fewer other entries than the cache holds were
used since the last use of the same one. That number doesn't depend on the capacity, so one pass answers for all of them.
The state is the stack of entries by their last use, of which the first ``most`` matter. It folds in blocks: a block's own
entries by last use, then what it left of the stack before it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass import storage
from tallyglass.functions import folds


def distances(uses: DataFrame, keys: list[str], order: list[str], entry: str, most: int = 64) -> DataFrame:
    """uses with depth: how many other entries of the key were used since this one was, null at ``most`` or at a first use.

    ``order`` has to tell a key's uses apart. A use of a null entry is none: its depth is null and it moves nothing.
    """
    kept = storage.stage(folds.placed(uses.withColumn("_entry", F.col(entry).cast("string")), keys, order))
    last = kept.filter("_entry is not null").groupBy(*keys, "_block", "_entry").agg(F.max("_at").alias("_last"))
    recent = F.slice(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("_last", "_entry")))), lambda x: x["_entry"]), 1, most)
    tops = last.groupBy(*keys, "_block").agg(recent.alias("_top"))
    kinds, names = {f.name: f.dataType.simpleString() for f in kept.schema}, list(uses.columns)
    key_fields = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, stack, out = pdf.sort_values("_block"), [], []
        for top in pdf["_top"]:
            out.append(stack)
            top = list(top)
            mine = set(top)
            stack = (top + [x for x in stack if x not in mine])[:most]
        return pdf.drop(columns="_top").assign(_stack=out)

    begun = tops.groupBy(*keys).applyInPandas(starts, f"{key_fields}, _block long, _stack array<string>")
    begun = begun.withColumnsRenamed({c: f"_of_{c}" for c in (*keys, "_block")})

    def run(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        stack, out = list(before["_stack"].iloc[0]) if len(before) else [], []
        for x in pdf["_entry"]:
            if x is None or x != x:
                out.append(None)
                continue
            at = stack.index(x) if x in stack else None
            out.append(at)
            if at is None:
                del stack[most - 1 :]
            else:
                del stack[at]
            stack.insert(0, x)
        return pdf[names].assign(depth=pd.array(out, "Int32"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in uses.schema)
    # a block's stack meets its rows in the task, once: joined to each row, it made them many times as large
    stacks = begun.groupBy(*[f"_of_{c}" for c in (*keys, "_block")])
    return kept.groupBy(*keys, "_block").cogroup(stacks).applyInPandas(run, f"{fields}, depth int")


def hit(depth: Column, capacity: int) -> Column:
    """Whether a cache of so many entries would have had the entry."""
    return F.coalesce(depth < capacity, F.lit(False))


def hit_rates(used: DataFrame, keys: list[str], capacities: tuple[int, ...]) -> DataFrame:
    """(keys, capacity, uses, hits): one aggregation whatever the number of capacities."""
    counts = used.groupBy(*keys).agg(F.count("*").alias("uses"), *[F.count_if(hit(F.col("depth"), c)).alias(f"_h{c}") for c in capacities])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("capacity"), F.col(f"_h{c}").alias("hits")) for c in capacities])).alias("x")
    return counts.select(*keys, "uses", each).select(*keys, "x.capacity", "uses", "x.hits")
