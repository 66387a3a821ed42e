"""Evaluation: induced defects, paired arms, headline metrics, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.functions import ordering, text

#: Of ten items one of each defect, the rest clean.
MODES = ("number_corrupted", "clause_swapped", "retrieval_dropped")


def headline(cases: DataFrame) -> DataFrame:
    """Rates with their counts, one row a metric; a rate without cases is null."""
    caught, clean = F.col("defective") & F.col("intervened"), ~F.col("defective")
    c = cases.agg(F.count_if(caught).alias("caught"), F.count_if("defective").alias("d"), F.count_if(clean & F.col("intervened")).alias("f"), F.count_if(clean).alias("c"))
    long = c.selectExpr("stack(4, 'catch_rate', caught, d, 'escape_rate', d - caught, d, 'false_intervention_rate', f, c, 'intervention_rate', caught + f, d + c) AS (metric, numerator, denominator)")
    return long.withColumn("value", F.when(F.col("denominator") > 0, F.round(F.col("numerator") / F.col("denominator"), 6)))


def bands(cases: DataFrame) -> DataFrame:
    a = F.col("amount_inr")
    band = F.when(a < 1000, "a_under_1000").when(a < 10000, "b_under_10000").when(a < 100000, "c_under_100000").otherwise("d_over")
    wrong, missed = ~F.col("defective") & F.col("intervened"), F.col("defective") & ~F.col("intervened")
    return cases.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_if(wrong).alias("false_interventions"), F.count_if(missed).alias("escapes"))


def paired(cases: DataFrame) -> DataFrame:
    """Every case in both arms; off never intervenes. One scan: the arms are an array, not a join."""
    both = cases.withColumn("arm", F.explode(F.array(F.lit("on"), F.lit("off")))).withColumn("acts", F.col("intervened") & (F.col("arm") == "on"))
    return both.groupBy("category", "arm").agg(F.count("*").alias("n"), F.count_if(F.col("defective") & ~F.col("acts")).alias("escapes"), F.count_if(~F.col("defective") & F.col("acts")).alias("false_interventions"))


def cluster_stats(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    sizes = rows.groupBy(cluster).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.count_if(F.col("n") > 1).alias("multi_item"), F.max("n").alias("largest"))


def usage(judgments: DataFrame, prompt_usd: str = "0.15", completion_usd: str = "0.60") -> DataFrame:
    """Totals over batches, each counted once; a batch whose rows disagree raises. Cost is exact."""
    facts = F.struct("prompt_tokens", "completion_tokens", "latency_ms")
    each = judgments.groupBy("batch_id").agg(F.min(facts).alias("f"), F.max(facts).alias("g")).select(
        F.when(F.col("f") == F.col("g"), F.col("f")).otherwise(F.raise_error(F.lit("rows of a batch disagree"))).alias("f")
    ).select("f.*")
    money = lambda c, rate: F.sum(c).cast("decimal(18,6)") * F.lit(rate).cast("decimal(4,2)") / 1000000
    cost = (money("prompt_tokens", prompt_usd) + money("completion_tokens", completion_usd)).cast("decimal(18,6)").cast("string")
    return each.agg(
        F.count("*").alias("batches"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), cost.alias("cost_usd"),
        F.percentile("latency_ms", F.lit(0.5)).alias("median_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95_ms"),
    )


def scorecard(seeds: DataFrame, target: float) -> DataFrame:
    """Worst and best seed of each metric: pass if all reach the target, miss if none does."""
    status = F.when(F.min("value") >= target, "pass").when(F.max("value") < target, "miss").otherwise("inconclusive")
    return seeds.groupBy("metric").agg(F.min("value").alias("worst"), F.max("value").alias("best"), status.alias("status"))


def assigned_modes(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """Exact quotas by place in key order: of ten, one of each defect, the rest clean; levels in turn."""
    mode = F.coalesce(F.get(F.array(*[F.lit(m) for m in MODES]), (F.col("_i") % 10).cast("int")), F.lit("clean"))
    return ordering.numbered(items, key, "_i").select(key, mode.alias("mode"), F.floor(F.col("_i") / 10) % 3).toDF(key, "mode", "level")


def induced(fragments: DataFrame) -> DataFrame:
    """Labelled items: an answer from a passage, its context, and the defect put in. What can't carry a defect stays clean.

    The mode follows from a hash of the document, so nothing is ordered and any number of rows works.
    """
    wanted = F.get(F.array(*[F.lit(m) for m in MODES]), F.pmod(F.xxhash64("doc_id"), F.lit(10)).cast("int"))
    # a sentence is tried where a run begins only, and a run is gone through once: one without an end would be tried from each place
    answer = F.regexp_extract("text", r"(?:^|[.!?\n])([^.!?\n]{40,}+[.!?])", 1)
    base = fragments.withColumn("answer", F.when(F.length(answer) > 0, answer).otherwise(F.col("text"))).withColumn("wanted", wanted)
    number, clause = F.size(text.figures(F.col("answer"))) > 0, F.size(text.clauses(F.col("answer"))) > 0
    can = (F.col("wanted") == "number_corrupted") & number | (F.col("wanted") == "clause_swapped") & clause | (F.col("wanted") == "retrieval_dropped")
    mode = F.when(can, F.col("wanted")).otherwise("clean")
    spoiled = F.when(F.col("mode") == "number_corrupted", F.regexp_replace("answer", r"([0-9])", "9$1")).when(F.col("mode") == "clause_swapped", F.regexp_replace("answer", r"(?i)(clause\s+)[0-9.]+", "$199.9")).otherwise(F.col("answer"))
    context = F.when(F.col("mode") == "retrieval_dropped", F.lit("")).otherwise(F.col("text"))
    out = base.withColumn("mode", mode).withColumn("fallback", F.col("wanted").isNotNull() & (F.col("mode") == "clean"))
    return out.select("doc_id", "domain", "provenance", "mode", "fallback", spoiled.alias("answer"), F.md5(context.cast("binary")).alias("context_md5"), (F.col("mode") != "clean").alias("label"))


def budgeted(batches: DataFrame, key: str, cost: str, most: float) -> DataFrame:
    """Which batches a budget allows, in the order of an integer key, with what has been spent by then. One row a batch."""
    summed = ordering.running_sum(batches.select(key, cost), key, cost, "spent")
    return summed.select(key, cost, "spent", (F.col("spent") <= most).alias("allowed"))
