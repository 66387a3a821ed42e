"""Numbers in key order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, key: str, name: str, width: int = 4096) -> DataFrame:
    """df with the place of each row in the order of an integer key, from 0.

    Keys fall into ranges of ``width``; a range numbers its own rows and starts after the rows of the ranges before it. Only
    the ranges' counts meet in one window.
    """
    ranged = df.withColumn("_range", F.floor(F.col(key) / width))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    placed = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1)
    return placed.join(starts, "_range").withColumn(name, F.col("_at") + F.col("_from")).drop("_range", "_at", "_from")


def running_sum(df: DataFrame, key: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """df with the sum of a column up to each row, in the order of an integer key; ranges of keys add up as in numbered()."""
    ranged = df.withColumn("_range", F.floor(F.col(key) / width))
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_at", F.sum(value).over(within))
    return placed.join(starts, "_range").withColumn(name, F.col("_at") + F.col("_from")).drop("_range", "_at", "_from")
