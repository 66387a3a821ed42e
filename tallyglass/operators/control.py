"""What surrounds a decision: detectors under a deadline, the gate's escapes, fallbacks, caches, reviews and their records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass import policy, schemas
from tallyglass.functions import folds, text

#: How long a verdict may take, the impact from which a bypass holds, and the budget of the detectors.
VERDICT_MS, HOLD_FROM_INR, RACE_MS = 8000.0, 1000.0, 250.0
#: Events that ride on a stream, argument names of amounts, and what models put before an answer.
STREAM_EVENTS = ("stakes", "signal", "decision", "hold")
AMOUNT_KEYS = ("amount", "amount_inr", "value", "sum", "total", "transfer_amount")
PREFIXES = ("corrected sentence:", "correction:", "answer:")
REASONING = "(?:think|thinking|reasoning)"


# -- gate and governor -----------------------------------------------------------------------------------------------


def verdict_outcome(latency_ms: Column, failed: Column, action: Column, limit: float = VERDICT_MS) -> Column:
    """(outcome, note): a verdict that fails or takes longer than the limit lets the sentence go, and says so."""
    late = F.struct(F.lit("released").alias("outcome"), F.lit("verdict timed out").alias("note"))
    broken = F.struct(F.lit("released").alias("outcome"), F.lit("verdict failed").alias("note"))
    return F.when(failed, broken).when(latency_ms > limit, late).otherwise(F.struct(action.alias("outcome"), F.lit("").alias("note")))


def escalated(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """df with mode: buffered from the first flagged row of a key on, and never back."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("mode", F.when(F.max(flag.cast("int")).over(so_far) == 1, "buffered").otherwise("passthrough"))


def bypass_action(impact_inr: Column, hold_from: float = HOLD_FROM_INR) -> Column:
    """Without checks, what is at stake decides: much is held, little passes."""
    return F.when(impact_inr >= hold_from, "L4_hold").otherwise("L0_pass")


def breaker_state(now: Column, opened_at: Column, cool_s: float = 30.0) -> Column:
    return F.when(opened_at.isNull(), "closed").when(now - opened_at >= cool_s, "half_open").otherwise("open")


# -- before the answer -----------------------------------------------------------------------------------------------


def raced(readings: DataFrame, budget_ms: float = RACE_MS) -> DataFrame:
    """readings (latency_ms, failed, raw, prob) with status; what is late or failed reads 0 with no probability."""
    status = F.when(F.col("latency_ms") > budget_ms, "late").when(F.col("failed"), "failed").otherwise("done")
    done = status == "done"
    return readings.withColumns({"status": status, "raw": F.when(done, F.col("raw")).otherwise(0.0), "prob": F.when(done, F.col("prob"))})


def dropped(raced_readings: DataFrame, key: str) -> DataFrame:
    """Names of the detectors that a request went without, in order."""
    gone = F.collect_list(F.when(F.col("status") != "done", F.col("name")))
    return raced_readings.groupBy(key).agg(F.array_join(F.array_sort(gone), ",").alias("dropped"))


def top_domain(fragments: DataFrame, key: str, order: str) -> DataFrame:
    """The most frequent domain of each key's fragments; of equals, the one seen first. general without any."""
    counts = fragments.filter("domain is not null and domain <> ''").groupBy(key, "domain").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(key).agg(F.max_by("domain", F.struct("n", -F.col("first"))).alias("_d"))
    return fragments.select(key).distinct().join(best, key, "left").select(key, F.coalesce("_d", F.lit("general")).alias("domain"))


def worst_tool(calls: DataFrame, key: str, tools: DataFrame) -> DataFrame:
    """The most irreversible tool that a request can reach; of equals, the first by name. Unknown tools count as the default."""
    default = policy.POLICY["tools"]["default"][0]
    known = calls.join(F.broadcast(tools), "tool", "left").withColumn("reversibility", F.coalesce("reversibility", F.lit(default)))
    rank = schemas.rank("reversibility", schemas.REVERSIBILITY)
    return known.groupBy(key).agg(F.min_by(F.struct("tool", "reversibility"), F.struct(-rank, "tool")).alias("w")).select(key, "w.tool", "w.reversibility")


def tool_name(wire: Column) -> Column:
    """A tool's name from either of its two shapes."""
    return F.trim(F.coalesce(F.get_json_object(wire, "$.function.name"), F.get_json_object(wire, "$.name"), F.lit("")))


def cheaper(left: Column, right: Column, prompt: int = 800, completion: int = 100) -> Column:
    """The cheaper of two models, priced by exact names, for a usual request; of equals the left."""
    prices = F.create_map(*[F.lit(x) for name, p, c, _ in policy.PRICES for x in (name, p * prompt / 1000 + c * completion / 1000)])
    fallback = F.lit(policy.FALLBACK_PRICE[0] * prompt / 1000 + policy.FALLBACK_PRICE[1] * completion / 1000)
    cost = lambda m: F.coalesce(F.try_element_at(prices, m), fallback)
    return F.when(cost(left) <= cost(right), left).otherwise(right)


# -- claims ----------------------------------------------------------------------------------------------------------


def overlap(claim: Column, passage: Column) -> Column:
    """A stand-in for entailment: the share of the claim's distinct content words that the passage has."""
    words = lambda c: F.array_distinct(text.content_words(c))
    share = lambda said: F.when(F.size(said) == 0, 0.0).otherwise(F.size(F.array_intersect(said, words(passage))) / F.size(said))
    return text.let(words(claim), share)


def claim_verdicts(claims: DataFrame, passages: DataFrame, key: str, entails=overlap, least: float = 0.5) -> DataFrame:
    """claims (key, claim_id, claim) with the best support any trusted passage of the key gives, which one, and a label.

    Without a trusted passage a claim is unjudged. Of equal supports the passage with the smallest id counts.
    """
    trusted = passages.filter(~F.endswith("provenance", F.lit("untrusted")) & (F.trim("passage") != ""))
    met = claims.join(trusted.select(key, "passage_id", "passage"), key).withColumn("support", F.round(entails(F.col("claim"), F.col("passage")), 9))
    best = met.groupBy(key, "claim_id").agg(F.max_by(F.struct("support", "passage_id"), F.struct("support", -F.col("passage_id"))).alias("b"))
    label = F.when(F.col("b").isNull(), "unjudged").when(F.col("b.support") >= least, "supported").otherwise("contradicted")
    return claims.join(best, [key, "claim_id"], "left").select(key, "claim_id", "claim", F.col("b.support").alias("support"), F.col("b.passage_id").alias("evidence_id"), label.alias("label"))


def least_supported(verdicts: DataFrame, key: str) -> DataFrame:
    """The judged claim with the smallest support, and how many claims no passage judged."""
    worst = F.min_by(F.when(F.col("support").isNotNull(), F.col("claim_id")), F.when(F.col("support").isNotNull(), F.struct("support", "claim_id")))
    return verdicts.groupBy(key).agg(
        worst.alias("worst_claim"), F.min("support").alias("support"), F.coalesce(F.bool_or(F.col("label") == "contradicted"), F.lit(False)).alias("any_unsupported"), F.count_if(F.col("label") == "unjudged").alias("unjudged")
    )


def observer_reading(score: Column, sentence: Column, premise: Column) -> Column:
    """A probability within [0, 1], or none for short sentences and without a premise."""
    return F.when((F.length(sentence) >= 20) & (F.trim(premise) != ""), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


# -- pairs and caches ------------------------------------------------------------------------------------------------


def twin_differences(a: Column, b: Column, tolerance: int = 2) -> Column:
    """Names of the fields in which two answers differ. An approval that one side doesn't state is no difference; hedges
    count from ``tolerance`` on."""
    plain = [F.when(a[f] != b[f], F.lit(f)) for f in ("amounts", "percentages", "action")]
    hedges = F.when(F.abs(a["hedges"] - b["hedges"]) >= tolerance, F.lit("hedging"))
    return F.array_compact(F.array(F.when(a["approved"] != b["approved"], F.lit("approved")), *plain, hedges))


def context_digest(fragments: Column) -> Column:
    """A digest of (provenance, text) pairs that depends on their order."""
    pair = lambda f: F.to_json(F.struct(f["provenance"].alias("provenance"), f["text"].alias("text")))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("["), F.array_join(F.transform(fragments, pair), ","), F.lit("]")), 256))


def cacheable(actions: Column, degraded: Column, question: Column, answer: Column) -> Column:
    """Only an answer that all decisions passed, made without degradation, may be kept."""
    stated = (F.coalesce(question, F.lit("")) != "") & (F.coalesce(answer, F.lit("")) != "")
    return ~degraded & stated & (F.size(actions) > 0) & F.forall(actions, lambda a: a == "L0_pass")


def miss_reasons(misses: DataFrame) -> DataFrame:
    """Misses by the leading clause of their reason, most frequent first."""
    lead = F.left(F.trim(F.split(F.split("reason", ";")[0], "--")[0]), F.lit(60))
    return misses.groupBy(lead.alias("bucket")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bucket")


def scope_digest(request: Column) -> Column:
    """A digest of a request's fields, whatever their order, without the one that only chooses streaming."""
    kept = F.map_filter(request, lambda k, _: k != "stream")
    pairs = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.sha2(F.array_join(pairs, "\u0001"), 256)


def rows_digest(rows: DataFrame, keys: list[str], id_col: str, line: Column) -> DataFrame:
    """One digest for each key's rows, whatever their order; the lines' digests are what is sorted."""
    lines = rows.select(*keys, F.struct(F.col(id_col), F.sha2(line, 256).alias("h")).alias("_r")).groupBy(*keys).agg(F.array_sort(F.collect_list("_r")).alias("_l"))
    return lines.select(*keys, F.sha2(F.array_join(F.transform("_l", lambda r: r["h"]), "\n"), 256).alias("digest"))


# -- fallbacks, economics, shapes ------------------------------------------------------------------------------------


def may_fall_back(tier: Column, streamed: Column, capacity_error: Column, served: Column) -> Column:
    """Whether a failed request may be tried on the cheap tier: nothing sent yet, and the strong model itself had no room."""
    return (tier == "strong") & ~streamed & capacity_error & (served == policy.STRONG)


#: What the economics page says where it has no numbers.
NO_SAMPLES, NOT_MEASURED = "no request-level net-value samples are available", " measurements are unavailable"


def economics_reason(requests: Column, samples: Column, net: Column, regret: Column, rework: Column) -> Column:
    """Why net value can't be shown; empty if it can."""
    none = F.lit(NO_SAMPLES)
    missing = F.array_compact(F.array(F.when(regret.isNull(), F.lit("regret")), F.when(rework.isNull(), F.lit("rework"))))
    told = F.concat(F.array_join(missing, " and "), F.lit(NOT_MEASURED))
    return F.when(requests == 0, none).when(F.size(missing) > 0, told).when((samples > 0) & net.isNotNull(), "").otherwise(none)


def decision_detail(decisions: DataFrame) -> DataFrame:
    """Decisions as they are shown: JSON decoded, missing versions empty, missing latency 0."""
    versions = {c: F.coalesce(c, F.lit("")) for c in ("policy_version", "calib_version", "inputs_digest")}
    return decisions.withColumns({
        **versions, "latency_ms": F.coalesce("latency_ms", F.lit(0.0)), "probs": F.coalesce(F.from_json("probs_json", "map<string,double>"), F.create_map().cast("map<string,double>")),
        "why": F.coalesce(F.from_json("why_json", "array<string>"), F.array().cast("array<string>")),
    }).drop("probs_json", "why_json")


def review_cards(holds: DataFrame, now: float, sla_s: float = 900.0) -> DataFrame:
    """What reviewers see of pending holds: everything but the token that resumes one."""
    deadline = F.coalesce("sla_deadline_ts", F.when(F.col("kind") == "response", F.col("created_ts") + sla_s))
    return holds.filter("state = 'pending'").select("hold_id", "kind", "state", "reason", "created_ts", deadline.alias("deadline_ts"), F.coalesce(F.lit(now) > deadline, F.lit(False)).alias("expired"))


def stream_allows(name: Column, on: Column, chosen: Column) -> Column:
    return on & F.array_contains(chosen, name) & name.isin(*STREAM_EVENTS)


def degraded_decision(reason: Column) -> Column:
    """What is decided when deciding fails: pass, and say why."""
    return F.struct(F.lit("L0_pass").alias("action"), F.lit(0.0).alias("chosen_loss"), F.concat(F.lit("degraded: "), reason).alias("why"), F.lit(True).alias("degraded"))


def calibrated(raw: Column, known: Column) -> Column:
    """(probs, degraded): only defects that have a calibrator get a probability; without any, the decision is degraded."""
    probs = F.map_filter(raw, lambda d, _: F.array_contains(known, d))
    return F.struct(probs.alias("probs"), ((F.size(known) == 0) | (F.size(probs) < F.size(raw))).alias("degraded"))


#: What a repair is told about unsupported clauses and figures.
CITES, STATES = ("cites ", ", which is not in the retrieved context"), ("states the figure(s) ", ", which appear nowhere in the retrieved context")


def repair_hint(action: Column, clauses: Column, figures: Column, evidence: Column) -> Column:
    """What a repair aims at, for repairs only: unsupported citations and figures, and at most three passages."""
    claims = F.array_compact(F.array(
        F.when(F.size(clauses) > 0, F.concat(F.lit(CITES[0]), F.array_join(F.transform(clauses, lambda c: F.concat(F.lit("Clause "), c)), ", "), F.lit(CITES[1]))),
        F.when(F.size(figures) > 0, F.concat(F.lit(STATES[0]), F.array_join(figures, ", "), F.lit(STATES[1]))),
    ))
    return F.when(action == "L2_repair", F.struct(claims.alias("claims"), F.slice(evidence, 1, 3).alias("evidence")))


def policy_distance(impact_scale: Column, deadband: Column, nuisance: Column) -> Column:
    """How far a policy's adjustment is from none at all."""
    return (1.0 - impact_scale) + deadband + (nuisance - 1.0) / 50.0


# -- tools and prompts -----------------------------------------------------------------------------------------------


def call_arguments(arguments: Column) -> Column:
    """(kind, arguments): an object as it is, any other JSON under '_', what doesn't parse under '_unparsed', none if blank."""
    blank = F.trim(F.coalesce(arguments, F.lit(""))) == ""
    value = F.get_json_object(arguments, "$")
    under = lambda key, v: F.create_map(F.lit(key), v)
    is_object = F.startswith(F.trim(arguments), F.lit("{")) & value.isNotNull()
    kind = F.when(blank, "none").when(is_object, "object").when(value.isNotNull(), "value").otherwise("unparsed")
    parsed = F.when(is_object, F.from_json(arguments, "map<string,string>"))
    return F.struct(kind.alias("kind"), F.when(kind == "object", parsed).when(kind == "value", under("_", value)).when(kind == "unparsed", under("_unparsed", arguments)).alias("arguments"))


def declared_amount(arguments: Column) -> Column:
    """The first of the argument names for amounts that holds a number, whatever marks it carries; no booleans."""
    number = lambda k: F.trim(F.regexp_replace(F.try_element_at(arguments, F.lit(k)), r",|₹|Rs\.", "")).try_cast("double")
    return F.coalesce(*[number(k) for k in AMOUNT_KEYS])


def argument_summary(names: Column, values: Column, limit: int = 6) -> Column:
    """The first arguments of a call in one line, and how many more there are."""
    shown = F.slice(F.zip_with(names, values, lambda k, v: F.concat(k, F.lit("="), v)), 1, limit)
    more = F.when(F.size(names) > limit, F.array(F.concat(F.lit("... +"), (F.size(names) - limit).cast("string"), F.lit(" more"))))
    return F.array_join(F.concat(shown, F.coalesce(more, F.array().cast("array<string>"))), ", ")


def tidied(completion: Column) -> Column:
    """A completion without its reasoning, as one line, without what models put before and around an answer."""
    out = F.regexp_replace(completion, rf"(?is)<{REASONING}\s*>.*?</{REASONING}\s*>", " ")
    out = F.regexp_replace(out, rf"(?is)<{REASONING}\s*>.*$", " ")
    out = F.trim(F.regexp_replace(out, rf"(?i)</?{REASONING}\s*>", " "))
    out = F.coalesce(F.get(F.filter(F.transform(F.split(out, "\n"), lambda line: F.trim(line)), lambda line: line != ""), F.lit(0)), F.lit(""))
    first = reduce(lambda a, p: a.when(F.startswith(F.lower(out), F.lit(p)), F.trim(F.substring(out, len(p) + 1, 1 << 30))), PREFIXES, F.when(F.lit(False), out)).otherwise(out)
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(first, '^"+|"+$', "")), '^"+|"+$', ""))


def short_secret(secret: Column) -> Column:
    """Enough of a secret to recognise it, never enough to use it."""
    return F.when(F.length(secret) > 20, F.concat(F.left(secret, F.lit(12)), F.lit("..."), F.right(secret, F.lit(4)))).otherwise(F.concat(F.left(secret, F.lit(4)), F.lit("...")))


def guessed_tokens(text_: Column) -> Column:
    """Tokens of a text for which nobody counted: a quarter of its characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text_) / 4).cast("int"))


def most_tokens(text_: Column) -> Column:
    """More tokens than a prompt can have: its bytes and a margin."""
    return F.octet_length(text_) + 512


# -- anchors, splits, probes -----------------------------------------------------------------------------------------


def gold_label(ungrounded: Column, contradicted: Column) -> Column:
    """The label that flags state; both at once is an error in the data and raises."""
    both = F.raise_error(F.lit("conflicting grounding labels")).cast("string")
    return F.when((ungrounded == 1) & (contradicted == 1), both).when(ungrounded == 1, "ungrounded").when(contradicted == 1, "contradicted").otherwise("clean")


def distractors(docs: DataFrame, n: int = 2) -> DataFrame:
    """(doc_id, rank, distractor_id): for each document one of another domain, from each of the next n domains.

    Documents are numbered within their domains in an order of their hashes; the k-th of one meets the k-th of the next,
    round and round. Domains and their sizes are a small table; no document meets a whole domain.
    """
    hashed = docs.select("doc_id", "domain", F.md5(F.col("doc_id").cast("string")).alias("_h"))
    numbered = folds.placed(hashed, ["domain"], ["_h", "doc_id"]).select("doc_id", "domain", F.col("_at").alias("k"))
    sizes = docs.groupBy("domain").agg(F.count("*").alias("size")).withColumn("d", F.row_number().over(Window.orderBy("domain")) - 1)
    n_domains = sizes.count()
    home = numbered.join(F.broadcast(sizes.select("domain", "d")), "domain")
    asks = home.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(max(1, min(n, n_domains - 1)))))).withColumn("d", (F.col("d") + F.col("rank")) % n_domains).filter(F.lit(n_domains > 1))
    asks = asks.select("doc_id", "rank", "d", "k").join(F.broadcast(sizes.select("d", "size")), "d").withColumn("k", F.col("k") % F.col("size"))
    return asks.join(home.select("d", "k", F.col("doc_id").alias("distractor_id")), ["d", "k"]).select("doc_id", "rank", "distractor_id")


def earliest_layer(curve: DataFrame, keys: list[str]) -> DataFrame:
    """The first layer whose area under the curve is within one standard error of the best one's; curve has layer, auroc, pos, neg."""
    best = Window.partitionBy(*keys).orderBy(F.desc("auroc"), "layer")
    top = curve.withColumn("_r", F.row_number().over(best)).filter("_r = 1")
    a, p, n = F.col("auroc"), F.col("pos"), F.col("neg")
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    error = F.sqrt(F.greatest(F.lit(0.0), (a * (1 - a) + (p - 1) * (q1 - a * a) + (n - 1) * (q2 - a * a)) / (p * n)))
    least = top.select(*keys, (a - error).alias("_least"), a.alias("best_auroc"))
    return curve.join(least, keys).filter(F.col("auroc") >= F.col("_least")).groupBy(*keys, "best_auroc").agg(F.min("layer").alias("layer"))


def fit_plan(labels: DataFrame, least: int = 30) -> DataFrame:
    """(defect, positives, note) for one-vs-rest calibrators: which are fitted, and why others are skipped."""
    counts = labels.groupBy("defect").agg(F.sum(F.col("y").cast("long")).alias("positives"))
    note = F.when(F.col("positives") < least, F.concat(F.lit("only "), F.col("positives").cast("string"), F.lit(f" positives (need {least})"))).otherwise("fitted")
    return counts.withColumn("note", note)


# -- records of runs -------------------------------------------------------------------------------------------------


def inconsistent_batches(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Batches whose rows don't agree on what a batch has once; rows and values that disagree are counted."""
    seen = rows.groupBy("batch_id").agg(F.count("*").alias("n"), F.count_distinct(F.struct(*columns)).alias("accounts"))
    return seen.filter("accounts > 1")


def repeated_ids(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1")


def unattributed(lanes: DataFrame, overhead: DataFrame, key: str) -> DataFrame:
    """(key, attributed_ms, unattributed_ms): the overhead that no lane claims, never below 0."""
    sums = lanes.groupBy(key).agg(F.sum("ms").alias("attributed_ms"))
    a = F.coalesce("attributed_ms", F.lit(0.0))
    return overhead.join(sums, key, "left").select(key, F.round(a, 6).alias("attributed_ms"), F.round(F.greatest(F.lit(0.0), F.col("overhead_ms") - a), 6).alias("unattributed_ms"))


def child_deadline(budget_ms: Column, elapsed_ms: Column, child_ms: Column) -> Column:
    """(remaining, child): what is left may be negative; a child never gets more than is left."""
    left = budget_ms - elapsed_ms
    return F.struct(left.alias("remaining_ms"), F.least(child_ms, F.greatest(F.lit(0.0), left)).alias("child_ms"))


def frames(raw: Column, schema: str) -> Column:
    """(frame, problem): a typed frame, or why there is none."""
    parsed = F.from_json(raw, schema + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    bad = F.when(raw.isNull() | (F.trim(raw) == ""), "empty").when(parsed["_broken"].isNotNull(), "malformed").when(parsed["event"].isNull(), "no event").when(~parsed["event"].isin(*STREAM_EVENTS), "unknown event")
    return F.struct(parsed.alias("frame"), bad.alias("problem"))
