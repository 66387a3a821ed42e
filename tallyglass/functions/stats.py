"""Statistics as columns and small aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Both ends of the score interval; without trials, 0 and 0."""
    p, zz = k / n, z * z
    middle, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    none = F.lit(0.0)
    return F.when(n == 0, none).otherwise(F.greatest(none, middle - half)), F.when(n == 0, none).otherwise(F.least(F.lit(1.0), middle + half))


def hoeffding(rate: Column, n: Column, alpha: float) -> Column:
    return F.when((n <= 0) | (rate >= alpha), 1.0).otherwise(F.exp(-2 * n * (F.lit(alpha) - rate) ** 2))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k), summed in log space from the first term on; exact for any n."""
    step = math.log(p) - math.log1p(-p)
    start = F.struct((n * math.log1p(-p)).alias("term"), F.exp(n * math.log1p(-p)).alias("total"))
    each = lambda acc, i: F.struct(
        (acc["term"] + F.ln((n - i + 1).cast("double") / i) + step).alias("term"), (acc["total"] + F.exp(acc["term"] + F.ln((n - i + 1).cast("double") / i) + step)).alias("total")
    )
    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(k < 0, 0.0).when(k >= n, 1.0).otherwise(F.least(F.lit(1.0), F.aggregate(terms, start, each, lambda acc: acc["total"])))


def bentkus(rate: Column, n: Column, alpha: float) -> Column:
    return F.least(F.lit(1.0), F.lit(math.e) * binomial_cdf(F.ceil(F.round(n * rate, 9)), n, alpha))


def hoeffding_bentkus(rate: Column, n: Column, alpha: float) -> Column:
    return F.least(hoeffding(rate, n, alpha), bentkus(rate, n, alpha))


def auroc_error(area: Column, positives: Column, negatives: Column) -> Column:
    """Standard error of an area under the ROC curve after Hanley and McNeil."""
    q1, q2 = area / (2 - area), 2 * area * area / (1 + area)
    variance = (area * (1 - area) + (positives - 1) * (q1 - area * area) + (negatives - 1) * (q2 - area * area)) / (positives * negatives)
    return F.when((positives > 0) & (negatives > 0), F.sqrt(F.greatest(F.lit(0.0), variance)))


def p_any(probs: Column) -> Column:
    """1 - prod(1 - p) over an array, each p clamped to [0, 1]."""
    return 1 - F.aggregate(probs, F.lit(1.0), lambda acc, p: acc * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))))


def always_valid_p(most: Column) -> Column:
    return F.least(F.lit(1.0), 1 / F.greatest(most, F.lit(1.0)))


def bootstrap_mean(df: DataFrame, key: str, value: str, resamples: int, seed: int, tail: float = 0.025) -> DataFrame:
    """(n, mean, low, high) of a Poisson bootstrap: each row gets a weight in each resample from a hash of its key.

    Weights need no second pass over the rows, and resamples are merged before the shuffle, so any number of rows works.
    """
    cumulative, limits, term = 0.0, [], math.exp(-1)
    for i in range(8):
        cumulative += term
        limits.append(cumulative)
        term /= i + 1
    uniform = (F.pmod(F.xxhash64(F.col(key), F.col("b"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40))
    weight = sum((F.when(uniform > limit, 1).otherwise(0) for limit in limits), F.lit(0))
    drawn = df.select(F.col(key), F.col(value)).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("w", weight)
    means = drawn.groupBy("b").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    low, high = max(0, int(tail * resamples) - 1), min(resamples - 1, int((1 - tail) * resamples))
    ends = means.agg(F.sort_array(F.collect_list("m")).alias("m")).select(F.get("m", F.lit(low)).alias("low"), F.get("m", F.lit(high)).alias("high"))
    return df.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).crossJoin(ends)
