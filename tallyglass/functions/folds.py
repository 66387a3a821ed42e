"""Ordered folds over keys of any size: running sums and maxima, looks back on the last rows, and paths of small machines.

A fold over a key's rows in order is a window with one task for the key, unless the fold's steps compose. Here a key's rows are
numbered without such a window (placed) and cut into blocks of BLOCK rows. Then

* running values come from within a block and from what all blocks before it add up to (running);
* what looks back on so many rows gets these from the block before as well (looking_back);
* a machine with a handful of states turns each block into a map from the state before it to the state after it, maps of blocks
  are composed in order, and each block runs once more from the state that it begins with (run_machine).

Only one row for each block, not for each row, meets the others of its key in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tallyglass import storage

BLOCK = 4096


def placed(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with _at, their place in their key's order from 0, and _block, the block of so many rows that they are in.

    Rows are dealt by ranges of keys and order, so that a key with most of the rows fills most of the ranges, and written once,
    as ranges come from samples. The order has to tell a key's rows apart. A range counts its rows of each key, and these
    counts, one for each key and range, are added up along the ranges.
    """
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    kept = storage.stage(ranged.withColumns({"_range": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
    counts = kept.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    joined = kept.alias("a").join(starts.alias("b"), same([*keys, "_range"]))
    at = F.col("a._id") - F.col("b._first") + F.col("b._from")
    out = joined.select(*[F.col(f"a.{c}") for c in rows.columns], at.alias("_at"))
    return out.withColumn("_block", F.floor(F.col("_at") / BLOCK))


def same(names: list[str]) -> Column:
    """Rows a and b that agree in some columns, nulls too."""
    on = F.lit(True)
    for name in names:
        on = on & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    return on


def running(rows: DataFrame, keys: list[str], values: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """placed rows with running values: name -> ("sum" or "max", column); exclusive ones are of the rows before, sums 0 at first.

    The rows are read twice, so they should be cheap or staged.
    """
    how = {"sum": F.sum, "max": F.max}
    each = rows.withColumns({f"_v_{name}": column for name, (_, column) in values.items()})
    blocks = each.groupBy(*keys, "_block").agg(*[how[kind](f"_v_{name}").alias(f"_b_{name}") for name, (kind, _) in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(*keys, "_block", *[how[kind](f"_b_{name}").over(earlier).alias(f"_s_{name}") for name, (kind, _) in values.items()])
    within = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inner = each.withColumns({f"_w_{name}": how[kind](f"_v_{name}").over(within) for name, (kind, _) in values.items()})
    joined = inner.alias("a").join(starts.alias("b"), same([*keys, "_block"]))

    def whole(name: str, kind: str) -> Column:
        start, own = F.col(f"b._s_{name}"), F.col(f"a._w_{name}")
        return F.coalesce(start, F.lit(0)) + F.coalesce(own, F.lit(0)) if kind == "sum" else F.greatest(start, own)

    return joined.select(*[F.col(f"a.{c}") for c in rows.columns], *[whole(name, kind).alias(name) for name, (kind, _) in values.items()])


def back(rows: int) -> WindowSpec:
    """The window of a row and those before it, so many in all; only for columns that looking_back() is given."""
    return Window.partitionBy("_part").orderBy("_at").rowsBetween(-(rows - 1), 0)


def looking_back(placed_rows: DataFrame, keys: list[str], rows: int, *columns: Column) -> DataFrame:
    """placed rows with columns over back(rows): each block also gets the last rows before it, which are dropped afterwards.

    Blocks have to be as long as the look back at least.
    """
    if rows > BLOCK:
        raise ValueError(f"a look back on {rows} rows is longer than a block of {BLOCK}")
    ahead = F.when(F.col("_at") % BLOCK > BLOCK - rows, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = placed_rows.withColumn("_halo", F.explode(ahead)).withColumn("_part", F.struct(*keys, (F.col("_block") + F.col("_halo")).alias("_block")))
    return dealt.select(*placed_rows.columns, "_halo", *columns).filter("_halo = 0").drop("_halo")


def run_machine(placed_rows: DataFrame, keys: list[str], states: int, step: Callable[[int, object], int], value: str, name: str) -> DataFrame:
    """placed rows with the state (0 to states - 1, from 0) of a machine after each: step(state, the row's value) is the next one."""
    kinds = {f.name: f.dataType for f in placed_rows.schema}
    key_fields = ", ".join(f"{k} {kinds[k].simpleString()}" for k in keys)

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        now = list(range(states))
        for v in pdf.sort_values("_at")[value]:
            now = [step(s, v) for s in now]
            if len(set(now)) == 1:  # from here on all starts go the same way
                now = now[:1]
        out = pdf[[*keys, "_block"]].iloc[:1].copy()
        out["_map"] = [now * (states if len(now) == 1 else 1)]
        return out

    needed = [*keys, "_block", "_at", value]
    mapped = placed_rows.select(*needed).groupBy(*keys, "_block").applyInPandas(maps, f"{key_fields}, _block long, _map array<int>")

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, out = pdf.sort_values("_block"), 0, []
        for m in pdf["_map"]:
            out.append(state)
            state = int(m[state])
        return pdf.drop(columns="_map").assign(_start=out)

    begun = mapped.groupBy(*keys).applyInPandas(starts, f"{key_fields}, _block long, _start int")
    joined = placed_rows.alias("a").join(begun.alias("b"), same([*keys, "_block"])).select("a.*", "b._start")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        state, out = int(pdf["_start"].iloc[0]), []
        for v in pdf[value]:
            state = step(state, v)
            out.append(state)
        return pdf.drop(columns="_start").assign(**{name: out})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed_rows.schema)
    return joined.groupBy(*keys, "_block").applyInPandas(run, f"{fields}, {name} int")
