"""Reading the ledger: spend, economics, latency, regret, fairness and holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass import policy
from tallyglass.functions import folds, stats


def priced(requests: DataFrame, prices: DataFrame, model: str = "model", longest: bool = False) -> DataFrame:
    """requests with book_model, prompt_inr, completion_inr and imputed of the book's row for the model.

    An exact name wins, else the first row in book order whose name begins the model (with ``longest``, the longest such
    name), else the fallback price with a null book_model. Models are looked up once each, not once a request.
    """
    exact = F.col(model) == F.col("book_model")
    order = (-F.length("book_model")) if longest else F.col("book_order")
    names = requests.select(model).distinct()
    found = (
        names.join(F.broadcast(prices), F.startswith(F.col(model), F.col("book_model")))
        .groupBy(model).agg(F.min_by(F.struct("book_model", "prompt_inr", "completion_inr", "imputed"), F.struct((~exact).alias("a"), order.alias("b"))).alias("price"))
    )
    out = requests.join(found, model, "left")
    fallback = dict(zip(("prompt_inr", "completion_inr"), policy.FALLBACK_PRICE))
    return out.select(
        *[F.col(c) for c in requests.columns], F.col("price.book_model").alias("book_model"), *[F.coalesce(F.col(f"price.{c}"), F.lit(v)).alias(c) for c, v in fallback.items()],
        F.coalesce(F.col("price.imputed"), F.lit(True)).alias("imputed"),
    )


def cost(prompt_inr: Column, completion_inr: Column) -> Column:
    return F.col("prompt_tokens") * prompt_inr / 1000 + F.col("completion_tokens") * completion_inr / 1000


def spend_by_request(spend: DataFrame) -> DataFrame:
    up = F.col("component") == "upstream"
    side = lambda is_up: F.round(F.sum(F.when(is_up, F.col("inr")).otherwise(0.0)), 6)
    return spend.groupBy("request_id").agg(side(up).alias("upstream_inr"), side(~up).alias("verification_inr"))


def spend_by_component(spend: DataFrame) -> DataFrame:
    return spend.groupBy("component", "model").agg(F.sum("tokens").alias("tokens"), F.round(F.sum("inr"), 6).alias("inr"))


def rework_by_kind(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("inr_charged"), 4).alias("inr"))


#: Components whose spend is checking in the totals.
CHECKING = ("observer", "verifier", "judge", "repair", "reroute")


def contributions(requests: DataFrame, spend: DataFrame, prices: DataFrame, shared: Column | float = 0.0) -> DataFrame:
    """(request_id, inr): all-strong baseline less what was paid and what checking cost, plus a shared adjustment."""
    strong = {m: (p, c) for m, p, c, _ in policy.PRICES}[policy.STRONG]
    own = priced(requests, prices).withColumn("modelled", cost(F.col("prompt_inr"), F.col("completion_inr"))).withColumn("baseline", cost(F.lit(strong[0]), F.lit(strong[1])))
    up = F.col("component") == "upstream"
    paid = spend.groupBy("request_id").agg(F.sum(F.when(up, F.col("inr")).otherwise(0.0)).alias("up"), F.sum(F.when(~up, F.col("inr")).otherwise(0.0)).alias("checks"))
    return own.join(paid, "request_id", "left").select(
        "request_id", (F.col("baseline") - F.coalesce("up", "modelled") - F.coalesce("checks", F.lit(0.0)) + shared).alias("inr")
    )


def economics(requests: DataFrame, spend: DataFrame, shadow: DataFrame, edges: DataFrame, prices: DataFrame) -> DataFrame:
    """One row: what traffic cost against sending everything to the strong model. What wasn't measured is null, never 0."""
    strong = {m: (p, c) for m, p, c, _ in policy.PRICES}[policy.STRONG]
    r = priced(requests, prices).agg(
        F.count("*").alias("requests"), F.count_if("cache_hit").alias("cache_hits"), F.coalesce(F.sum(cost(F.col("prompt_inr"), F.col("completion_inr"))), F.lit(0.0)).alias("modelled"),
        F.coalesce(F.sum(cost(F.lit(strong[0]), F.lit(strong[1]))), F.lit(0.0)).alias("baseline"),
    )
    s = spend.agg(
        F.coalesce(F.sum(F.when(F.col("component") == "upstream", F.col("inr"))), F.lit(0.0)).alias("recorded"), F.coalesce(F.sum(F.when(F.col("component").isin(*CHECKING), F.col("inr"))), F.lit(0.0)).alias("checking")
    )
    h = shadow.agg(F.count("*").alias("regret_samples"), F.coalesce(F.sum(F.greatest(F.col("inr_saved_if_switched"), F.lit(0.0))), F.lit(0.0)).alias("regret"))
    w = edges.agg(F.count("*").alias("rework_samples"), F.coalesce(F.sum("inr_charged"), F.lit(0.0)).alias("rework"))
    upstream = F.when(F.col("recorded") != 0, F.col("recorded")).otherwise(F.col("modelled"))
    measured = (F.col("requests") > 0) & (F.col("regret_samples") > 0) & (F.col("rework_samples") > 0)
    one = r.crossJoin(s).crossJoin(h).crossJoin(w).withColumn("upstream", upstream)  # each side is a single row
    savings = F.col("baseline") - F.col("upstream")
    return one.select(
        "requests", "cache_hits", F.round("upstream", 4).alias("upstream_spend_inr"),
        F.when(F.col("recorded") != 0, "recorded").when(F.col("requests") > 0, "imputed").otherwise("unmeasured").alias("upstream_spend_basis"),
        F.round("checking", 4).alias("verification_spend_inr"), F.when(F.col("upstream") > 0, F.round(F.col("checking") / F.col("upstream"), 6)).alias("verification_cost_ratio"),
        F.round(savings, 4).alias("routing_savings_inr"), F.when(F.col("regret_samples") > 0, F.round("regret", 4)).alias("regret_inr"), "regret_samples",
        F.when(F.col("rework_samples") > 0, F.round("rework", 4)).alias("rework_inr"), "rework_samples",
        F.when(measured, F.round(savings - F.col("rework") - F.col("checking") - F.col("regret"), 4)).alias("net_value_inr"),
    )


def ranked_percentiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles per key. Counts by value replace the list of values: a hot key's rows are merged before
    the shuffle, and only distinct values are ordered."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*keys).orderBy(column)
    upto = counts.withColumn("_upto", F.sum("_n").over(order)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    hit = lambda share: F.min(F.when(F.col("_upto") > F.bround(F.lit(share) * (F.col("_all") - 1)), F.col(column)))
    return upto.groupBy(*keys).agg(*[hit(s).alias(name) for name, s in shares.items()])


def ledger_summary(requests: DataFrame) -> DataFrame:
    """Counts and overhead by tenant; p95 is the value at ceil(0.95 n)."""
    return requests.groupBy("tenant").agg(
        F.count("*").alias("requests"), F.count_if("degraded").alias("degraded"), F.round(F.avg("overhead_ms"), 4).alias("overhead_mean_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY overhead_ms)").alias("overhead_p95_ms"),
    )


def rolling_p95(requests: DataFrame, rows: int = 200) -> DataFrame:
    """Nearest-rank p95 of the last rows of each tenant; a tenant with all rows is spread over as many tasks as any other."""
    placed = folds.placed(requests.select("tenant", "request_id", "ts", "overhead_ms"), ["tenant"], ["ts", "request_id"])
    return folds.looking_back(placed, ["tenant"], rows, p95_of_last(rows).alias("p95_ms")).select("tenant", "request_id", "p95_ms")


def p95_of_last(rows: int) -> Column:
    """Nearest-rank p95 of overhead_ms over the row and those before it, for folds.looking_back()."""
    values = F.sort_array(F.collect_list("overhead_ms").over(folds.back(rows)))
    return F.get(values, F.bround(F.lit(0.95) * (F.size(values) - 1)).cast("int"))


def unpriced(requests: DataFrame, prices: DataFrame) -> DataFrame:
    return priced(requests, prices).filter("book_model is null").groupBy("model").agg(F.count("*").alias("misses"))


def regret_estimate(shadow: DataFrame, population: int) -> DataFrame:
    """Mean regret, what it is over the population, and how often the strong model wasn't needed; reliable from 30."""
    return shadow.agg(
        F.count("*").alias("n"), F.round(F.avg("regret_inr"), 6).alias("mean_inr"), F.round(F.avg("regret_inr") * population, 4).alias("scaled_inr"),
        F.round(F.count_if("sufficed") / F.count("*"), 6).alias("over_routing_rate"), (F.count("*") >= 30).alias("reliable"),
    )


def disparate(delta: str = "delta", base: str = "base_value", twin: str = "twin_value") -> Column:
    """A pair differs by its delta, or where that is null or no number, by its values."""
    number = F.expr(f"try_cast({delta} AS DOUBLE)")
    return F.coalesce(F.abs(number) > 0, F.col(base) != F.col(twin))


def fairness_by_axis(pairs: DataFrame) -> DataFrame:
    d = pairs.withColumn("_d", disparate())
    return d.groupBy("attribute").agg(F.count("*").alias("n"), F.count_if("_d").alias("disparate"), F.round(F.count_if("_d") / F.count("*"), 4).alias("rate"))


def effective_deadline(sla: str = "sla_deadline_ts", kind: str = "kind", created: str = "created_ts") -> Column:
    return F.coalesce(F.col(sla), F.when(F.col(kind) == "response", F.col(created)))


def pending_holds(holds: DataFrame, now: float) -> DataFrame:
    """Pending cards by creation, without the resume token."""
    deadline = effective_deadline()
    return holds.filter("state = 'pending'").select("hold_id", "kind", "created_ts", deadline.alias("deadline_ts"), F.coalesce(F.lit(now) > deadline, F.lit(False)).alias("expired"))


def hold_states(events: DataFrame) -> DataFrame:
    """The state each hold ends in: the first resolution that counts wins. An approval needs the token and an open SLA."""
    valid = (F.col("event") == "reject") | (F.col("event") == "expire") | ((F.col("event") == "approve") & F.col("token_ok") & (F.col("ts") <= F.col("deadline_ts")))
    first = events.filter(valid).groupBy("hold_id").agg(F.min_by("event", F.struct("ts", "seq")).alias("first"), F.min("ts").alias("resolved_ts"))
    state = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("approve", "approved", "reject", "rejected", "expire", "expired")]), F.col("first")), F.lit("pending"))
    return events.select("hold_id").distinct().join(first, "hold_id", "left").select("hold_id", state.alias("state"), "resolved_ts")


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last version of each key: an upsert read back from an append-only table."""
    if not keys:
        return rows
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(version)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*rows.columns)


def net_value_interval(contribution: DataFrame, resamples: int = 200, seed: int = 20260829) -> DataFrame:
    """A percentile bootstrap of the mean contribution."""
    return stats.bootstrap_mean(contribution, "request_id", "inr", resamples, seed)
