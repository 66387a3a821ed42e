"""Stakes, routing, and the cheapest safe action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass import policy, schemas

#: Role multipliers and the depth from which a conversation counts as struggling.
ROLES = {"customer": 1.0, "agent": 1.2, "underwriter": 1.5, "admin": 2.0}
DEEP, DEEP_FACTOR = 3, 1.25


def band_multiplier(amount: Column, bands: dict[float, float] = policy.POLICY["bands"]) -> Column:
    """Multiplier of the highest band that the amount is over or at."""
    out = F.when(F.lit(False), F.lit(1.0))
    for floor, factor in sorted(bands.items(), reverse=True):
        out = out.when(amount >= floor, factor)
    return out.otherwise(1.0)


def stakes(requests: DataFrame, domains: DataFrame, default_impact: float = policy.POLICY["default_impact_inr"]) -> DataFrame:
    """requests with impact_inr, reversibility and confidence.

    Needs domain (null if unknown), domain_source, amount_inr, user_role, depth and tool_reversibility (or null).
    """
    joined = requests.join(F.broadcast(domains), "domain", "left")
    role = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.col("user_role")), F.lit(1.0))
    impact = F.coalesce("base_impact", F.lit(default_impact)) * F.when(F.col("amount_inr") > 0, band_multiplier(F.col("amount_inr"))).otherwise(1.0) * role
    impact = impact * F.when(F.col("depth") >= DEEP, DEEP_FACTOR).otherwise(1.0)
    base, tool = schemas.rank(F.coalesce("base_reversibility", F.lit("reversible")), schemas.REVERSIBILITY), schemas.rank("tool_reversibility", schemas.REVERSIBILITY)
    confidence = F.when(F.col("domain_source") == "retrieved", F.when(F.col("n_retrieved") >= 2, 0.9).otherwise(0.75)).when(F.col("domain_source") == "intent", 0.55).otherwise(0.25)
    return joined.select(*requests.columns, F.round(impact, 2).alias("impact_inr"), schemas.at_rank(F.greatest(base, tool), schemas.REVERSIBILITY).alias("reversibility"), confidence.alias("confidence"))


def tier(impact: Column, difficulty: Column, flagged: Column, limit: float = policy.POLICY["strong_model_above_impact_inr"]) -> Column:
    """Strong for what was flagged before, for high stakes and for hard questions."""
    return F.when(flagged | (impact >= limit) | (difficulty >= 0.65), "strong").otherwise("cheap")


def gate_mode(impact: Column, limit: float = policy.POLICY["buffer_above_impact_inr"]) -> Column:
    return F.when(impact >= limit, "buffered").otherwise("passthrough")


def options(items: DataFrame, book: dict = policy.POLICY, adjustment: dict | None = None) -> DataFrame:
    """items with _options: for each action, in ladder order, the four terms of its loss, its total and whether it can be taken.

    Needs impact_inr, reversibility, probs (a map of defect to probability), emitted and feasible_pass (booleans). Actions
    and efficacies are literals, so nothing is joined and nothing shuffles; a defect that the policy doesn't know counts nothing.
    """
    a = adjustment or book["decision_adjustment"]
    p = {d: F.greatest(F.lit(0.0), F.coalesce(F.try_element_at("probs", F.lit(d)), F.lit(0.0)) - a["probability_deadband"]) for d in book["defect"]}
    reverse = F.coalesce(*[F.when(F.col("reversibility") == r, F.lit(float(x))) for r, x in book["reversibility"].items()])
    rows = items.withColumns({f"_p_{d}": c for d, c in p.items()} | {"_reverse": reverse})
    clean = F.lit(1.0)
    for d in p:
        clean = clean * (1 - F.least(F.lit(1.0), F.col(f"_p_{d}")))
    harms = {f"_h_{d}": F.col(f"_p_{d}") * F.col("impact_inr") * a["impact_scale"] * float(book["defect"][d]) * F.col("_reverse") for d in p}
    rows = rows.withColumns({"_any": 1 - clean} | harms)

    def option(i: int, act: str) -> Column:
        harm = F.lit(0.0)
        for d in p:
            harm = harm + F.col(f"_h_{d}") * (1 - float(book["efficacy"].get(act, {}).get(d, 0.0)))
        nuisance = (1 - F.col("_any")) * float(book["nuisance_inr"][act]) * a["nuisance_multiplier"]
        compute = F.lit(float(book["compute_tokens"][act]) * book["price_inr_per_1k_tokens"] / 1000 + (float(book["review_cost_inr"]) if act in ("L4_hold", "L5_block") else 0.0))
        latency = F.lit(book["lambda_time_inr_per_second"] * float(book["latency_ms"][act]) / 1000)
        available = F.lit(True)
        if act in ("L2_repair", "L3_reroute", "L5_block"):
            available = available & ~F.col("emitted")
        if act == "L0_pass":
            available = available & F.col("feasible_pass")
        return F.struct(
            F.lit(act).alias("action"), F.lit(i).alias("ladder"), harm.alias("residual_harm"), nuisance.alias("nuisance"), compute.alias("compute"), latency.alias("latency"),
            (harm + nuisance + compute + latency).alias("total"), available.alias("available"),
        )

    every = F.array(*[option(i, act) for i, act in enumerate(schemas.ACTIONS)])
    return rows.withColumn("_options", every).drop("_reverse", "_any", *[f"_{x}_{d}" for x in "ph" for d in p])


def priced_actions(items: DataFrame, key: str = "item_id", book: dict = policy.POLICY, adjustment: dict | None = None) -> DataFrame:
    """Six rows for each item: the four terms of each action's loss, its total and whether it can be taken."""
    # one column an action first: exploding them in the same step would make one function of all
    rows = options(items, book, adjustment).select(key, *[F.get("_options", F.lit(i)).alias(f"_a{i}") for i in range(len(schemas.ACTIONS))])
    return rows.select(key, F.explode(F.array(*[f"_a{i}" for i in range(len(schemas.ACTIONS))])).alias("_o")).select(key, "_o.*")


def chosen(priced: DataFrame, key: str = "item_id", hard_rules: DataFrame | None = None) -> DataFrame:
    """The cheapest action that can be taken, ties to the lower rung; a hard rule overrides, the most drastic one first.

    ``priced`` is what options() returns, or rows of priced_actions(), which are gathered by key first.
    """
    if "_options" not in priced.columns:
        names = [c for c in priced.columns if c not in (key, "ladder")]
        priced = priced.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ladder", *names))).alias("_options"))
    # six columns instead of an array that is sorted: unavailable ones are null, which least() leaves out
    at = [F.get("_options", F.lit(i)) for i in range(len(schemas.ACTIONS))]
    each = [F.when(o["available"], F.struct(o["total"].alias("total"), o["ladder"].alias("ladder"), o["action"].alias("action"))) for o in at]
    best = priced.select(key, "_options", *[c.alias(f"_o{i}") for i, c in enumerate(each)]).withColumn("_first", F.least(*[f"_o{i}" for i in range(len(each))]))
    later = [F.when(F.col(f"_o{i}.ladder") != F.col("_first.ladder"), F.col(f"_o{i}")) for i in range(len(each))]
    best = best.withColumn("_second", F.least(*later))
    out = best.select(
        key, F.col("_first.action").alias("cheapest"), F.col("_first.total").alias("cheapest_loss"), F.col("_second.action").alias("runner_up"),
        (F.col("_second.total") - F.col("_first.total")).alias("margin"), "_options",
    )
    if hard_rules is None:
        return out.select(key, F.col("cheapest").alias("action"), F.col("cheapest_loss").alias("chosen_loss"), "runner_up", "margin")
    rule = hard_rules.withColumn("_r", schemas.rank("rule_action", schemas.ACTIONS)).groupBy(key).agg(F.max_by(F.struct("rule", "rule_action", "_r"), F.col("_r")).alias("h"))
    joined = out.join(rule, key, "left")
    return joined.select(
        key, F.coalesce("h.rule_action", "cheapest").alias("action"), F.when(F.col("h").isNotNull(), F.get("_options", F.col("h._r"))["total"]).otherwise(F.col("cheapest_loss")).alias("chosen_loss"),
        F.col("h.rule").alias("hard_rule"),
    )


#: Three cases whose actions no adjustment of the policy may change.
CONTRACTS = (
    ("high_stakes_hold", 0.31, 40_000.0, "costly", "L4_hold"), ("low_stakes_repair", 0.31, 200.0, "reversible", "L2_repair"), ("low_risk_pass", 0.01, 200.0, "reversible", "L0_pass"),
)


def contract_actions(spark: SparkSession, adjustment: dict | None = None) -> DataFrame:
    """(item_id, expected, action, kept) for each of the three cases under an adjustment of the policy."""
    df = spark.createDataFrame([c for c in CONTRACTS], "item_id string, p double, impact_inr double, reversibility string, expected string")
    items = df.withColumns({"probs": F.create_map(F.lit("ungrounded"), F.col("p")), "emitted": F.lit(False), "feasible_pass": F.lit(True)})
    out = chosen(options(items, adjustment=adjustment)).select("item_id", "action").join(df.select("item_id", "expected"), "item_id")
    return out.select("item_id", "expected", "action", (F.col("action") == F.col("expected")).alias("kept"))


def break_even(impact: Column, reversibility: Column, book: dict = policy.POLICY, steps: int = 60) -> Column:
    """The least P(ungrounded) at which passing stops being cheapest, by bisection; neutral adjustment."""
    reverse = F.element_at(F.create_map(*[F.lit(x) for kv in book["reversibility"].items() for x in kv]), reversibility)

    def loss(action: str, p: Column) -> Column:
        effect = book["efficacy"][action].get("ungrounded", 0.0)
        fixed = book["compute_tokens"][action] * book["price_inr_per_1k_tokens"] / 1000 + (book["review_cost_inr"] if action in ("L4_hold", "L5_block") else 0) + book["lambda_time_inr_per_second"] * book["latency_ms"][action] / 1000
        return p * impact * reverse * (1 - effect) + (1 - p) * book["nuisance_inr"][action] + fixed

    others = lambda p: F.least(*[loss(a, p) for a in schemas.ACTIONS[1:]])

    def step(acc: Column, _: Column) -> Column:
        middle = (acc["lo"] + acc["hi"]) / 2
        stays = loss("L0_pass", middle) <= others(middle)
        return F.struct(F.when(stays, middle).otherwise(acc["lo"]).alias("lo"), F.when(stays, acc["hi"]).otherwise(middle).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: acc["hi"])


def tool_decisions(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """allow or hold for each call: a cap first, then what can be undone, then the taint of what influenced it."""
    default = {t: r for t, (r, _) in policy.POLICY["tools"].items()}["default"]
    joined = calls.join(F.broadcast(tools), "tool", "left").withColumn("declared", F.col("reversibility").isNotNull()).withColumn("reversibility", F.coalesce("reversibility", F.lit(default)))
    tainted = schemas.rank("taint", schemas.PROVENANCE) >= schemas.PROVENANCE.index("retrieved_untrusted")
    capped = F.col("max_auto_inr").isNotNull() & (F.col("amount_inr") > F.col("max_auto_inr"))
    verdict = F.when(capped, "hold").when(F.col("reversibility") == "reversible", "allow").when(tainted, "hold").otherwise("allow")
    reason = F.when(capped, "over_cap").when(F.col("reversibility") == "reversible", "reversible").when(tainted, "tainted").otherwise("clean")
    return joined.select(*calls.columns, "reversibility", "declared", verdict.alias("verdict"), reason.alias("reason"))


def most_tainted(labels: DataFrame, key: str) -> DataFrame:
    """The weakest provenance of each key; unknown labels don't count, and nothing is system."""
    ranked = labels.groupBy(key).agg(F.coalesce(F.max(schemas.rank("provenance", schemas.PROVENANCE)), F.lit(0)).alias("r"))
    return ranked.select(key, schemas.at_rank(F.col("r"), schemas.PROVENANCE).alias("provenance"))


def candidate_grid(spark, impact_scales=(0.25, 0.5, 0.75, 1.0, 1.25, 1.5), deadbands=(0.0, 0.005, 0.01, 0.015, 0.02, 0.03), nuisances=(1.0, 2.0, 5.0, 10.0, 15.0, 20.0)) -> DataFrame:
    """216 policy adjustments with their distance from the neutral one."""
    rows = [(i * 36 + j * 6 + k, s, d, n) for i, s in enumerate(impact_scales) for j, d in enumerate(deadbands) for k, n in enumerate(nuisances)]
    return spark.createDataFrame(rows, "candidate int, impact_scale double, deadband double, nuisance_multiplier double")


def pareto(candidates: DataFrame, costs: list[str]) -> DataFrame:
    """Candidates that none other dominates: at least as good everywhere and better somewhere."""
    x, y = candidates.alias("x"), F.broadcast(candidates.alias("y"))  # one row a candidate of a fixed grid
    no_worse = [F.col(f"y.{c}") <= F.col(f"x.{c}") for c in costs]
    better = [F.col(f"y.{c}") < F.col(f"x.{c}") for c in costs]
    on, some = no_worse[0], better[0]
    for a, b in zip(no_worse[1:], better[1:]):
        on, some = on & a, some | b
    return x.join(y, on & some, "left_anti")
