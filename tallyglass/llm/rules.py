"""Quality rules: a decision list learned by sequential covering and applied as Spark expressions.

Features are counts over whole texts. A rule is a conjunction of threshold conditions that rejects. It is grown on two
thirds of the labelled rows, one condition at a time by information gained about low-quality rows, then cut back on the last
third to the prefix that separates best there; rows that it covers leave, and the next rule is grown on the rest. The list
ends when a rule isn't precise enough. Statistics come from grouped counts of binned features; only those counts (features
by bins) reach the driver. Everything is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm import common

#: The marks that count as symbols, and white space.
SYMBOLS, SPACE = "#*$%&|<>", " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = ("n_words", "chars_per_word", "symbols_per_word", "repeat_share", "dup_lines_per_100_words", "upper_share", "bangs_per_word")
QUANTILES = tuple(k / 48 for k in range(49))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(words: Column) -> Column:
    """How many words lie in windows of three that the text holds twice or more."""

    def of_hashes(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def of_ordered(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            places = F.array_sort(F.transform(twice, lambda x: x["p"]))
            start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
            step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
            return F.aggregate(places, start, step, lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(ordered, of_ordered))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(_let(hashes, of_hashes))


def counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper and n_bangs; null texts count as empty."""
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    less = lambda marks: F.length(text) - F.length(F.translate(text, marks, ""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    by_words = _let(common.words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated_words(w).alias("r")))
    by_lines = _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return (
        docs.drop(*made).withColumn("_rules_words", by_words)
        .withColumns({
            "n_words": F.col("_rules_words.n"), "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"), "n_symbols": less(SYMBOLS).cast("long"),
            "n_dup_lines": by_lines, "n_repeat_words": F.col("_rules_words.r"), "n_upper": less(UPPER).cast("long"), "n_bangs": less("!").cast("long"),
        }).drop("_rules_words")
    )


def feature_columns() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"), "chars_per_word": F.col("word_chars") / n, "symbols_per_word": F.col("n_symbols") / n,
        "repeat_share": F.col("n_repeat_words") / n, "dup_lines_per_100_words": F.col("n_dup_lines") / n * 100, "upper_share": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "bangs_per_word": F.col("n_bangs") / n,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, columns: dict[str, Column]) -> Column:
        value = columns[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def fires(rule: Rule, columns: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, (c.holds(columns) for c in rule))


def rejects(rules: list[Rule], columns: dict[str, Column] | None = None) -> Column:
    """Number of the first rule that fires, from 1, or 0: an ordered CASE WHEN."""
    columns = columns or feature_columns()
    first = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        first = F.when(fires(rule, columns), F.lit(i)).otherwise(first)
    return first


def _by_bin(rows: DataFrame, thresholds: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """Good and bad rows for each feature and bin; bin k holds what exceeds k of the thresholds."""
    below = lambda f, ts: F.size(F.filter(F.array(*[F.lit(t) for t in ts]), lambda t: t < F.col(f)))
    bins = {f: below(f, ts) if ts else F.lit(0) for f, ts in thresholds.items()}
    long = rows.select("bad", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), b.alias("k")) for f, b in bins.items()])).alias("x"))
    out = {f: [[0, 0] for _ in range(len(ts) + 1)] for f, ts in thresholds.items()}
    for row in long.groupBy("x.f", "x.k", "bad").count().collect():
        out[row["f"]][row["k"]][row["bad"]] += row["count"]
    return out


def _gain(good: int, bad: int, before: float) -> float:
    return bad * (math.log2(bad / (bad + good)) - before) if bad else 0.0


def _grow(rows: DataFrame, thresholds: dict[str, list[float]], pure: float, longest: int) -> Rule:
    rule: list[Condition] = []
    columns = {f: F.col(f) for f in FEATURES}
    while len(rule) < longest:
        table = _by_bin(rows, thresholds)
        good, bad = (sum(b[k] for b in table[FEATURES[0]]) for k in (0, 1))
        if not bad or bad / (good + bad) >= pure:
            break
        before, best, found = math.log2(bad / (good + bad)), 1e-9, None
        for f in FEATURES:
            for k, t in enumerate(thresholds[f]):
                for above, side in ((True, table[f][k + 1 :]), (False, table[f][: k + 1])):
                    gain = _gain(sum(b[0] for b in side), sum(b[1] for b in side), before)
                    if gain > best + 1e-9:
                        best, found = gain, Condition(f, above, t)
        if found is None:
            break
        rule.append(found)
        rows = rows.filter(found.holds(columns))
    return tuple(rule)


def _pruned(rule: Rule, rows: DataFrame) -> tuple[Rule, int, int]:
    """The prefix with the best (bad - good) / (bad + good), and its good and bad rows."""
    columns = {f: F.col(f) for f in FEATURES}
    sums = [F.sum(F.when(fires(rule[:k], columns) & (F.col("bad") == b), 1).otherwise(0)) for k in range(1, len(rule) + 1) for b in (0, 1)]
    seen = [x or 0 for x in rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    scored = [((seen[2 * k + 1] - seen[2 * k]) / max(1, seen[2 * k] + seen[2 * k + 1]), -k) for k in range(len(rule))]
    k = -max(scored)[1]
    return rule[: k + 1], seen[2 * k], seen[2 * k + 1]


def learn(docs: DataFrame, labels: DataFrame, most_labels: int = 6000, precision: float = 0.95, longest: int = 3, most_rules: int = 8) -> list[Rule]:
    """A list of rejecting rules from labels (doc_id, quality: 0 is bad).

    Fits on at most ``most_labels`` labelled rows, those with the smallest hash of their doc_id; rows that the base rules
    reject anyway take no part. A rule needs ``precision`` on the rows held back for pruning, and at least five bad rows
    there. Without labels, or with labels of one kind only, the list is empty.
    """
    picked = (
        labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    )
    columns = feature_columns()
    rows = (
        counts(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))
        .select(base_failed().alias("base_failed"), F.when(F.col("_quality") == 0, 1).otherwise(0).alias("bad"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)).alias("fold"), *[c.alias(f) for f, c in columns.items()])
    )
    # written before the filter, which would otherwise be moved below the join and count every text
    rows = common.stage(rows.repartition(1)).filter(~F.col("base_failed"))
    cuts = rows.agg(*[F.percentile(f, F.array(*[F.lit(q) for q in QUANTILES])).alias(f) for f in FEATURES]).first()
    if cuts is None or cuts[0] is None:
        return []
    # halfway between neighbouring quantiles: a threshold on a value itself would leave no margin
    values = {f: sorted(set(cuts[f])) for f in FEATURES}
    thresholds = {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in values.items()}
    grow, prune, rules = rows.filter("fold < 2"), rows.filter("fold = 2"), []
    while len(rules) < most_rules:
        rule = _grow(grow, thresholds, 0.995, longest)
        if not rule:
            break
        rule, good, bad = _pruned(rule, prune)
        if bad < 5 or bad < precision * (good + bad):
            break
        rules.append(rule)
        covered = fires(rule, {f: F.col(f) for f in FEATURES})
        grow, prune = grow.filter(~covered), prune.filter(~covered)
    return rules


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with their counts, base_failed, rule (0, or the first rule that rejects) and kept.

    A null or empty text has no words and fails the base rules. Columns of docs named like those added are replaced; rows
    are neither merged nor dropped, whatever their doc_id.
    """
    return (
        counts(docs.drop("base_failed", "rule", "kept")).withColumn("base_failed", base_failed()).withColumn("rule", rejects(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )
