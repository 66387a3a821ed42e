"""Whether numbers can be trusted: calibration error, ranking, thresholds with guarantees, monitors, agreement, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass import storage
from tallyglass.functions import folds, stats

BINS, STEP = 10, 0.005
WARMUP, SAFETY, MU0, ALPHA = 10, 0.5, 0.05, 0.05


def bin_of(p: Column, bins: int = BINS) -> Column:
    """Equal bins (lo, hi]; the first also takes 0."""
    return F.greatest(F.lit(0), F.ceil(F.round(p * bins, 9)) - 1).cast("int")


def reliability(scored: DataFrame, keys: list[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    """All bins with their size, mean score and observed rate; empty ones hold zeros."""
    keys = list(keys)
    seen = scored.groupBy(*keys, bin_of(F.col(p)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))
    spark = scored.sparkSession
    every = spark.range(BINS).select(F.col("id").cast("int").alias("bin"))
    if keys:
        every = scored.select(*keys).distinct().crossJoin(F.broadcast(every))  # ten rows
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return every.join(seen, [*keys, "bin"], "left").select(*keys, "bin", zero("n", 0), zero("mean_p", 0.0), zero("rate", 0.0))


def calibration_error(scored: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    per = scored.groupBy(*keys, bin_of(F.col(p)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mp"), F.avg(y).alias("my"))
    return per.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def auroc(scored: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Area under the ROC curve with ties at half, Brier score, and the standard error. Counts by score come first, so the
    order is over distinct scores and not over rows; without both classes the area is null."""
    by = scored.groupBy(*keys, p).agg(F.sum(y).alias("pos"), F.count("*").alias("n"), F.sum((F.col(p) - F.col(y)) ** 2).alias("sq"))
    neg = F.col("n") - F.col("pos")
    below = F.coalesce(F.sum(neg).over(Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = by.withColumn("wins", F.col("pos") * (below + neg / 2)).groupBy(*keys).agg(F.sum("wins").alias("w"), F.sum("pos").alias("positives"), F.sum("n").alias("n"), F.sum("sq").alias("sq"))
    negatives = F.col("n") - F.col("positives")
    out = s.select(*keys, "n", "positives", F.when((F.col("positives") > 0) & (negatives > 0), F.col("w") / (F.col("positives") * negatives)).alias("auroc"), (F.col("sq") / F.col("n")).alias("brier"))
    return out.withColumn("auroc_se", stats.auroc_error(F.col("auroc"), F.col("positives"), F.col("n") - F.col("positives")))


def threshold_sweep(scored: DataFrame, alpha: float, delta: float, p: str = "p", y: str = "y", step: float = STEP) -> DataFrame:
    """Each threshold of the grid with its escape and intervention rate, p-value, and whether it is certified.

    A defective item escapes below the threshold. Thresholds are tested from 0 on and testing stops at the first that can't
    be rejected. Items are counted by grid cell once; the sweep is a running sum over some 200 cells.
    """
    cells = round(1 / step)
    at = F.greatest(F.lit(0), F.least(F.lit(cells + 1), F.floor(F.round(F.col(p) / step, 9)) + 1)).cast("int")  # the first threshold above p
    counts = scored.groupBy(at.alias("cell")).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    grid = scored.sparkSession.range(cells + 1).select(F.col("id").cast("int").alias("cell"))
    upto = Window.orderBy("cell")
    every = Window.partitionBy()
    full = grid.join(F.broadcast(counts), "cell", "full").withColumns({"pos": F.coalesce("pos", F.lit(0)), "n": F.coalesce("n", F.lit(0))})
    run = full.withColumns({"escaped": F.sum("pos").over(upto), "passed": F.sum("n").over(upto), "defective": F.sum("pos").over(every), "all": F.sum("n").over(every)}).filter(F.col("cell") <= cells)
    rate = F.when(F.col("defective") > 0, F.col("escaped") / F.col("defective")).otherwise(0.0)
    tested = run.withColumn("escape_rate", rate).withColumn("intervention_rate", F.when(F.col("all") > 0, 1 - F.col("passed") / F.col("all")).otherwise(0.0))
    tested = tested.withColumn("p_value", stats.hoeffding_bentkus(F.col("escape_rate"), F.col("defective"), alpha))
    held = F.min((F.col("p_value") <= delta).cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    return tested.select((F.col("cell") * step).alias("threshold"), "escape_rate", "intervention_rate", "p_value", (held == 1).alias("certified"))


def evalues(rows: DataFrame, keys: list[str], order: list[str], x: str = "x", mu0: float = MU0, warmup: int = WARMUP, safety: float = SAFETY, alpha: float = ALPHA) -> DataFrame:
    """A betting martingale per key: bets from strictly earlier rows, its value, running maximum, p-value and latched alert.

    ``order`` has to tell a key's rows apart. A key's rows are folded in blocks, so one key may hold all rows. Over a long key
    e_value leaves the range of doubles; log_e doesn't.
    """
    value = F.col(x).cast("double")
    counted = {"_n": ("sum", F.when(value.isNotNull(), 1).otherwise(0)), "_s": ("sum", value), "_q": ("sum", value * value)}
    prior = folds.running(folds.placed(rows, keys, order), keys, counted, inclusive=False)
    mean, square = F.col("_s") / F.nullif(F.col("_n"), F.lit(0)), F.col("_q") / F.nullif(F.col("_n"), F.lit(0))
    prior = prior.withColumns({"_m": mean, "_q": square})
    excess, spread = F.col("_m") - mu0, F.greatest(F.lit(1e-12), F.col("_q") - F.col("_m") ** 2)
    bet = F.when((F.col("_n") < warmup) | (excess <= 0), 0.0).otherwise(F.least(excess / (spread + excess * excess), F.lit(safety / mu0)))
    stepped = storage.stage(prior.withColumn("bet", bet).withColumn("_step", F.ln(1 + F.col("bet") * (value - mu0))))
    summed = storage.stage(folds.running(stepped, keys, {"_log": ("sum", F.col("_step"))}))
    out = folds.running(summed, keys, {"_most": ("max", F.col("_log"))})
    out = out.withColumns({"e_value": F.exp("_log"), "max_e": F.greatest(F.lit(1.0), F.exp("_most")), "t": F.col("_n") + 1})
    out = out.withColumns({"p_value": stats.always_valid_p(F.col("max_e")), "alerted": F.col("max_e") >= 1 / alpha})
    return out.select(*rows.columns, "bet", F.col("_log").alias("log_e"), "e_value", "max_e", "t", "p_value", "alerted")


def agreement(rows: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Strict and binary agreement of a judge with gold, false interventions and escapes, for each set of slices.

    Needs gold and judged in {clean, ungrounded, contradicted}; a null judgment is left out of every rate.
    """
    bad = lambda c: F.col(c) != "clean"
    names = list(dict.fromkeys(c for s in sets for c in s))
    judged = rows.filter("judged is not null")
    aggs = [
        F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("judged")).alias("strict"), F.count_if(bad("gold") == bad("judged")).alias("binary"),
        F.count_if(~bad("gold")).alias("clean"), F.count_if(~bad("gold") & bad("judged")).alias("false_interventions"), F.count_if(bad("gold")).alias("defective"), F.count_if(bad("gold") & ~bad("judged")).alias("escapes"),
    ]
    return judged.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(*aggs)


def confusion(rows: DataFrame, labels: tuple[str, ...] = ("clean", "ungrounded", "contradicted")) -> DataFrame:
    return rows.filter("judged is not null").groupBy("gold").pivot("judged", list(labels)).count().na.fill(0, list(labels))


def judge_agreement(rows: DataFrame, flagged: str = "flagged", judged: str = "judged_bad") -> DataFrame:
    """Agreement over judged rows only; unclear judgments are counted apart, and misses apart from over-flagging."""
    known = F.col(judged).isNotNull()
    return rows.agg(
        F.count("*").alias("n"), F.count_if(~known).alias("unclear"), F.round(F.count_if(known & (F.col(judged) == F.col(flagged))) / F.count_if(known), 6).alias("agreement"),
        F.count_if(known & F.col(judged) & ~F.col(flagged)).alias("missed"), F.count_if(known & ~F.col(judged) & F.col(flagged)).alias("over_flagged"),
    )


def input_shift(fitted: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Change of each key's share between two sets, over the keys of both."""
    share = lambda d, name: d.groupBy(key).agg(F.count("*").alias("n")).select(key, (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))
    both = share(fitted, "was").join(share(current, "now"), key, "full")
    return both.select(key, F.round(F.coalesce("now", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)), 4).alias("shift"))


def drift_verdict(anchors: Column, ece: Column, fitted_ece: Column, judge_alarm: Column, shift: Column) -> Column:
    """Too few anchors say nothing; error at 0.10 or an alarmed judge ends trust, thrice the fitted error calls for a watch."""
    return F.struct(
        F.when(anchors < 50, "watch").when((ece >= 0.10) | judge_alarm, "untrusted").when(ece > 3 * fitted_ece, "watch").otherwise("trusted").alias("trust"),
        F.when(anchors < 50, "too_few_anchors").when(ece >= 0.10, "calibration").when(judge_alarm, "judge").when(ece > 3 * fitted_ece, "drifting").otherwise("none").alias("reason"),
        (shift >= 0.10).alias("input_shifted"),
    )


def efficacy_cells(outcomes: DataFrame) -> DataFrame:
    cells = outcomes.groupBy("action", "defect").agg(F.count("*").alias("n"), F.count_if("removed").alias("k"))
    low, high = stats.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return cells.select("action", "defect", "n", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def probe_scores(vectors: DataFrame, mean: list[float], scale: list[float], weights: list[float], bias: float) -> DataFrame:
    """A linear probe: standardised, weighted, squashed."""
    m, s, w = (F.array(*[F.lit(float(v)) for v in x]) for x in (mean, scale, weights))
    z = F.zip_with(F.zip_with("embedding", m, lambda a, b: a.cast("double") - b), s, lambda a, b: a / b)
    logit = F.aggregate(F.zip_with(z, w, lambda a, b: a * b), F.lit(float(bias)), lambda acc, v: acc + v)
    return vectors.select("vec_id", (1 / (1 + F.exp(-logit))).alias("score"))


class Calibrator:
    """Isotonic regression of each signal, then logistic fusion; plain knots and weights that save as JSON.

    Signals are fitted on counts by value, so the fit's size follows the distinct scores and not the rows.
    """

    def __init__(self, knots: dict[str, list[tuple[float, float]]], weights: dict[str, float], bias: float):
        self.knots, self.weights, self.bias = knots, weights, bias

    @classmethod
    def fit(cls, rows: DataFrame, signals: list[str], y: str = "y", places: int = 3, c: float = 1.0) -> Calibrator:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import IsotonicRegression

        knots = {}
        for s in signals:
            counts = rows.filter(F.col(s).isNotNull()).groupBy(F.round(s, places).alias("x")).agg(F.avg(F.col(y).cast("double")).alias("label"), F.count("*").cast("double").alias("w"))
            model = IsotonicRegression(featuresCol="x", labelCol="label", weightCol="w").fit(counts)
            knots[s] = list(zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist()))
        half = cls(knots, {}, 0.0)
        calibrated = rows.select(F.col(y).cast("double").alias("label"), *[half.one(s).alias(s) for s in signals])
        n = calibrated.count()
        vectors = VectorAssembler(inputCols=signals, outputCol="features").transform(calibrated.na.fill(0.0, signals))
        fit = LogisticRegression(regParam=1 / (c * max(1, n)), standardization=False).fit(vectors)
        return cls(knots, dict(zip(signals, fit.coefficients.toArray().tolist())), float(fit.intercept))

    def one(self, signal: str) -> Column:
        """The signal's own calibration, linear between knots and flat beyond; an unknown signal passes through."""
        x, knots = F.col(signal), self.knots.get(signal)
        if not knots:
            return x
        out = F.when(x <= knots[0][0], knots[0][1])
        for (a, pa), (b, pb) in zip(knots, knots[1:]):
            if b > a:
                out = out.when(x <= b, pa + (x - a) / (b - a) * (pb - pa))
        return F.when(x.isNotNull(), out.otherwise(knots[-1][1]))

    def probability(self) -> Column:
        logit = sum((F.coalesce(self.one(s), F.lit(0.0)) * w for s, w in self.weights.items()), F.lit(self.bias))
        return 1 / (1 + F.exp(-logit))

    def to_dict(self) -> dict:
        return {"knots": self.knots, "weights": self.weights, "bias": self.bias}

    @classmethod
    def from_dict(cls, given: dict) -> Calibrator:
        return cls({s: [tuple(k) for k in ks] for s, ks in given["knots"].items()}, given["weights"], given["bias"])


def out_of_fold(rows: DataFrame, signals: list[str], key: str, y: str = "y", folds: int = 5) -> DataFrame:
    """(key, y, fold, p): every row scored by a model that hasn't seen it. Folds come from a hash of the key."""
    dealt = rows.withColumn("fold", F.pmod(F.xxhash64(key, F.lit(5)), F.lit(folds)).cast("int"))
    out = None
    for fold in range(folds):
        model = Calibrator.fit(dealt.filter(F.col("fold") != fold), signals, y)
        part = dealt.filter(F.col("fold") == fold).select(key, y, "fold", model.probability().alias("p"))
        out = part if out is None else out.unionByName(part)
    return out

