"""Smaller operators: directives, canaries, argument tracing, caches, judge replies, sampling, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass import policy, schemas

#: Phrases that mean a provider is out of capacity.
CAPACITY = ("rate limit", "quota", "overloaded", "capacity", "too many requests")


def directive(raw: Column) -> Column:
    """defect, sentence and probability of ``defect@index[:p]``; null if malformed or out of range."""
    shape = r"^([a-z_]+)@([0-9]+)(?::([0-9]*\.?[0-9]+))?$"
    defect, at, p = (F.regexp_extract(raw, shape, i) for i in (1, 2, 3))
    chance = F.when(p == "", 0.95).otherwise(p.try_cast("double"))
    good = raw.rlike(shape) & defect.isin(*schemas.DEFECTS) & chance.between(0.0, 1.0)
    return F.when(good, F.struct(defect.alias("defect"), at.cast("int").alias("sentence"), chance.alias("p")))


def selected_model(requested: Column) -> Column:
    """Sentinel names stand for a tier's model; any other name passes through."""
    return F.when(requested.isNull() | requested.isin("auto", "default", ""), F.lit(policy.STRONG)).when(requested == "cheap", F.lit(policy.CHEAP)).otherwise(requested)


def capacity_error(message: Column) -> Column:
    return F.lower(message).rlike("|".join(CAPACITY))


def canary_hits(texts: DataFrame, canaries: DataFrame) -> DataFrame:
    """(text_id, canary, owner, start, end, cross_tenant) of every planted canary that a text of some tenant repeats.

    A canary has a shape, so it is looked up by key: texts are searched once, whatever the number of canaries.
    """
    shape = r"\bIL-CANARY-[A-Za-z0-9_-]+\b"  # case matters here as in the join
    found = texts.select("text_id", "tenant", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(shape), F.lit(0)))).alias("canary"))
    hit = found.join(canaries, "canary").withColumn("start", F.expr("instr(text, canary)") - 1)
    return hit.select("text_id", "canary", "owner", "start", (F.col("start") + F.length("canary")).alias("end"), (F.col("owner") != F.col("tenant")).alias("cross_tenant"))


def argument_strings(arguments: DataFrame, column: str = "args") -> DataFrame:
    """(call_id, value): text and numbers at any depth of JSON arguments; booleans and nulls carry nothing."""
    leaves = F.regexp_extract_all(F.col(column), F.lit(r'[:\[,]\s*("(?:[^"\\]|\\.)*"|-?[0-9]+(?:\.[0-9]+)?)(?=\s*[,\]}])'), F.lit(1))
    return arguments.select("call_id", F.explode(leaves).alias("value")).withColumn("value", F.regexp_replace("value", r'^"|"$', ""))


def _argument_tokens(value: Column) -> Column:
    return F.regexp_extract_all(F.lower(value), F.lit(r"[a-z0-9]+(?:[.@][a-z0-9]+)*"), F.lit(0))


def traced(values: DataFrame, fragments: DataFrame) -> DataFrame:
    """(call_id, value, doc_id, provenance): fragments of the call's request that an argument comes from.

    An argument comes from a fragment that has its words in a row, or nine tenths of at least three; a single word of
    fewer than four letters proves nothing. Calls meet only their own request's fragments.
    """
    a = values.withColumn("_w", _argument_tokens(F.col("value"))).filter((F.size("_w") > 1) | (F.length(F.get("_w", F.lit(0))) >= 4))
    f = fragments.withColumn("_t", _argument_tokens(F.col("text")))
    met = a.join(f, "request_id")
    row = F.contains(F.concat(F.lit(" "), F.array_join("_t", " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")))
    most = (F.size("_w") >= 3) & (F.size(F.filter("_w", lambda w: F.array_contains(F.col("_t"), w))) >= 0.9 * F.size("_w"))
    return met.filter(row | most).select("call_id", "value", "doc_id", "provenance")


def influence(calls: DataFrame, traces: DataFrame, fragments: DataFrame) -> DataFrame:
    """(call_id, taint, tier): the weakest source that arguments trace to, else any untrusted in the request, else its weakest."""
    own = traces.groupBy("call_id").agg(F.max(schemas.rank("provenance", schemas.PROVENANCE)).alias("r1"))
    every = fragments.groupBy("request_id").agg(F.max(schemas.rank("provenance", schemas.PROVENANCE)).alias("r2"))
    out = calls.join(own, "call_id", "left").join(every, "request_id", "left")
    tier = F.when(F.col("r1").isNotNull(), "traced").when(F.col("r2") >= schemas.PROVENANCE.index("retrieved_untrusted"), "untrusted_context").otherwise("context")
    return out.select("call_id", schemas.at_rank(F.coalesce("r1", "r2", F.lit(0)), schemas.PROVENANCE).alias("taint"), tier.alias("tier"))


def lru(entries: DataFrame, scope: str, keep: int) -> DataFrame:
    """What a cache of ``keep`` entries in each scope still holds: the most recently used."""
    return entries.withColumn("_n", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("last_used"), F.desc("entry_id")))).filter(F.col("_n") <= keep).drop("_n")


def judge_reply(text: Column) -> Column:
    """supported (null if unclear), confidence and rationale of a free reply; a negative answer is looked for first."""
    supported = F.when(text.rlike(r"(?i)\b(not supported|unsupported|contradict\w*|no)\b"), False).when(text.rlike(r"(?i)\b(supported|yes)\b"), True)
    score = F.get(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]*\.?[0-9]+"), F.lit(0)), lambda x: x.cast("double")), lambda v: v <= 1.0), F.lit(0))
    line = F.get(F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 20), F.lit(0))
    return F.struct(supported.alias("supported"), score.alias("confidence"), F.trim(line).alias("rationale"))


def response_status(http: Column, body: Column) -> Column:
    """What came of a judge's call."""
    label = F.get_json_object(body, "$.label")
    return (
        F.when(http == 429, "rate_limited").when(http == 402, "no_credit").when(http.isin(401, 403), "unauthorized").when(http >= 500, "provider_error").when(http >= 400, "rejected")
        .when(body.isNull() | (F.trim(body) == ""), "empty").when(F.try_parse_json(body).isNull(), "invalid_json").when(F.get_json_object(body, "$.refusal").isNotNull(), "refused")
        .when(label.isNull(), "missing_label").when(~label.isin("clean", "ungrounded", "contradicted", "unclear"), "unknown_label").when(label == "unclear", "unclear").otherwise("valid")
    )


def sampled(key: Column, share: float, seed: int = 0) -> Column:
    """A fixed share of keys, the same on every run."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256), 1, 8), 16, 10).cast("long") < F.lit(int(share * (1 << 32)))


#: Fixed value: the largest share of requests that a judge may see.
JUDGE_CEILING = 0.05


def judge_sampled(key: Column, share: float, seed: int = 0) -> Column:
    """A share of requests for the judge; a share above the ceiling is refused."""
    if not 0.0 <= share <= JUDGE_CEILING:
        raise ValueError(f"a judge sees at most {JUDGE_CEILING:.0%} of requests, not {share:.2%}")
    return sampled(key, share, seed)


def rows_digest(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """A digest of each key's rows in order: canonical JSON, a line a row."""
    line = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n"), 256).alias("digest"))


def accounted(cost: Column, attempts: Column, estimate: Column, projection: Column) -> Column:
    """What a batch is charged: what the provider said, with an estimate for each retry, else the larger guess for all."""
    return F.when(cost.isNotNull(), cost + (attempts - 1) * estimate).otherwise(F.greatest(estimate, projection) * attempts)


def evidence_rows(requests: DataFrame, decisions: DataFrame, spend: DataFrame) -> DataFrame:
    """One nested row for each request: its decisions and spend as arrays in order."""
    d = decisions.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("ladder", "action", "total"))).alias("decisions"))
    s = spend.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("component", "tokens"))).alias("spend"))
    return requests.join(d, "request_id", "left").join(s, "request_id", "left")


def probe_fit(vectors: DataFrame, label: Column, holdout: float = 0.3) -> tuple[list[float], list[float], list[float], float, float]:
    """Mean, scale, weights, bias and held-out area of a linear probe; classes weigh the same, the hold-out is by hash."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"), label.cast("double").alias("label"), sampled(F.col("vec_id"), holdout).alias("held"))
    train = rows.filter("not held")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(train)
    n, positives = train.agg(F.count("*"), F.sum("label")).first()
    weigh = F.when(F.col("label") == 1, n / (2 * max(1.0, positives))).otherwise(n / (2 * max(1.0, n - positives)))
    model = LogisticRegression(weightCol="w", regParam=1 / max(1, n), standardization=False).fit(scaler.transform(train).withColumn("w", weigh))
    area = BinaryClassificationEvaluator().evaluate(model.transform(scaler.transform(rows.filter("held"))))
    scale = [float(s) if s > 0 else 1.0 for s in scaler.std.toArray()]
    return scaler.mean.toArray().tolist(), scale, model.coefficients.toArray().tolist(), float(model.intercept), float(area)
