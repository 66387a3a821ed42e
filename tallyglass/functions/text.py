"""Text as columns: words, grounding, injection, money, identifiers, decisions.

Patterns use explicit ASCII classes and no look-around, so that RE2 engines agree with Java's; where a rule needs its
surroundings, the pattern matches them and a group picks the part.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words without content, hedging words, and openers of procedural sentences.
STOP = (
    "a an and any are as at be been but by can could do does for from had has have how i if in into is it its may me my no not of on or our "
    "shall should so than that the their them then there these they this to was we were what when where which who will with would you your"
).split()
HEDGES = (
    "about appears approximately around cannot confirm could depending estimated generally likely may might often please possibly roughly seems "
    "subject typically unable unclear unlikely usually"
).split()
PROCEDURAL = (
    "let me", "i will", "i'll", "i am going to", "i'm going to", "i have reviewed", "i've reviewed", "i can help", "i'd be happy", "i would be happy", "let us",
    "checking", "searching", "one moment", "please hold", "thank you", "sure,", "certainly", "of course", "happy to help", "i understand",
)
SESSION_STOP = "a an and are as at be by can do does for from how i in is it me my of on or please that the to was what when where which will with you your".split()
#: The injection grammar, label, pattern and weight; the last three look for text hidden from readers.
INJECTION = (
    ("instruction_override", r"\b(ignore|disregard|forget|override)\b[^.\n]{0,40}\b(previous|prior|earlier|above|all)\b[^.\n]{0,20}\b(instruction|prompt|direction|rule|message)s?\b", 0.95),
    ("role_reassignment", r"\byou\s+are\s+now\b|\bact\s+as\s+(?:a|an|the)\b|\bnew\s+(?:system\s+)?(?:prompt|instructions?|persona)\b|\bpretend\s+(?:to\s+be|you)\b", 0.75),
    ("exfiltration", r"\b(email|send|forward|upload|post|transmit|share)\b[^.\n]{0,60}(?:to\s+)?[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}", 0.9),
    ("exfiltration_url", r"\b(send|post|upload|exfiltrate|transmit)\b[^.\n]{0,60}https?://", 0.85),
    ("authority_claim", r"\b(?:this\s+has\s+)?already\s+been\s+(?:approved|authorised|authorized|verified)\b|\bthe\s+(?:audit|security|compliance)\s+team\s+(?:has|have)\b", 0.6),
    ("secret_disclosure", r"\b(reveal|repeat|print|show|output|disclose)\b[^.\n]{0,30}\b(system\s+prompt|instructions|api\s+key|password|secret)\b", 0.9),
    ("compliance_bait", r"\bconfirm\s+that\s+you\s+have\s+done\s+so\b|\bdo\s+not\s+mention\b|\bwithout\s+(?:telling|informing|notifying)\s+the\s+user\b", 0.7),
)
HIDDEN = (
    ("white_text_css", r"color\s*:\s*(?:#f{3,6}|white|rgb\(\s*255\s*,\s*255\s*,\s*255\s*\))", 0.8),
    ("zero_size_font", r"font-size\s*:\s*0(?:\.0+)?(?:px|pt|em)?", 0.8),
    ("display_none", r"display\s*:\s*none|visibility\s*:\s*hidden", 0.8),
)
INVISIBLE = "​‌‍⁠﻿‪‫‬‭‮"
#: What a text must hold, whatever its case, for a rule to match: one of each group. Cheap to look for, and most texts have none.
NEEDED = {
    "instruction_override": (("ignore", "disregard", "forget", "override"), ("instruction", "prompt", "direction", "rule", "message")),
    "role_reassignment": (("now", "act", "new", "pretend"),), "exfiltration": (("@",),), "exfiltration_url": (("://",),), "authority_claim": (("been", "team"),),
    "secret_disclosure": (("prompt", "instructions", "key", "password", "secret"),), "compliance_bait": (("confirm", "mention", "without"),),
    "white_text_css": (("color",),), "zero_size_font": (("font-size",),), "display_none": (("display", "visibility"),),
}
#: Confident phrases and what softens them.
SOFTER = {
    "will always": "should normally", "will never": "should not normally", "always": "normally", "never": "not normally", "definitely": "likely", "certainly": "likely",
    "guaranteed": "expected", "guarantees": "is expected to provide", "must be": "is generally", "is required to": "is generally expected to", "there is no": "there does not appear to be",
    "you are entitled to": "you may be entitled to", "you will receive": "you should receive", "this is": "this appears to be",
}
#: Fixed value: what marks a claim that nothing retrieved supports.
UNVERIFIED = "[not verified against the retrieved documents]"
#: Keywords of each domain.
INTENT = {
    "prepayment": ("prepay", "prepayment", "foreclose", "foreclosure", "part payment", "pay off early"), "loan_terms": ("loan", "emi", "tenure", "interest rate", "eligibility", "sanction", "mortgage"),
    "claims": ("claim", "insurance", "settle", "surveyor", "dispute", "unauthorised", "fraud"), "fees": ("fee", "charge", "penalty", "levy", "commission"),
    "payments": ("transfer", "neft", "rtgs", "imps", "upi", "remit", "send money", "payment"), "branch_info": ("branch", "open", "timing", "hours", "address", "ifsc", "atm", "location"),
}
#: What makes a question hard, and how much.
HARD = (
    (r"(?i)\b(and also|as well as|additionally|furthermore|;)\b", 0.8), (r"(?i)\b(compare|versus|vs\.?|difference between|better|cheaper|which of)\b", 0.9),
    (r"(?i)\b(if|unless|provided that|in case|when|whether)\b", 0.5), (r"(?i)\b(calculate|how much|how many|total|interest|emi|rate)\b", 0.7),
)
#: Refusals, approvals, hedges, figures and clause numbers in texts.
REFUSE = r"(?i)\b(not eligible|cannot|declined|rejected|unable|do not qualify|does not qualify|ineligible|not approved)\b"
APPROVE = r"(?i)\b(approved|eligible|qualify|qualifies|sanctioned|you can|you may|granted)\b"
HEDGED = r"(?i)\b(may|might|could|possibly|typically|generally|usually|approximately|around|subject to|depending|please confirm|cannot confirm)\b"
FIGURE = r"(?:^|[^0-9A-Za-z_.])([0-9]+(?:,[0-9]{2,3})*(?:\.[0-9]+)?)"
CLAUSE = r"(?i)\b(?:clause|section|article)\s+([0-9]+(?:\.[0-9]+)?)"


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tokens(text: Column) -> Column:
    """Lower-case words and numbers; decimals and clause numbers stay whole."""
    return found(F.lower(text), r"[a-z0-9]+(?:\.[0-9]+)*")


def words(text: Column) -> Column:
    return found(F.lower(text), r"[a-z0-9]+(?:[.'-][a-z0-9]+)*")


def content_words(text: Column) -> Column:
    stop = _lits(STOP)
    return F.filter(words(text), lambda w: ~F.array_contains(stop, w))


def unsupported_content(answer: Column, context: Column) -> Column:
    """Share of the answer's content words that the context doesn't have; a null context supports nothing."""
    share = let(content_words(answer), lambda said: unsupported_share(said, content_words(context)))
    return F.when(context.isNull(), let(content_words(answer), lambda said: F.when(F.size(said) == 0, 0.0).otherwise(1.0))).otherwise(share)


def figures(text: Column) -> Column:
    """Numbers as plain text: without commas, whole ones without a point."""
    plain = F.transform(found(text, FIGURE, 1), lambda x: F.regexp_replace(x, ",", ""))
    return F.transform(plain, lambda x: F.when(x.cast("double") == F.floor(x.cast("double")), F.floor(x.cast("double")).cast("string")).otherwise(x.cast("double").cast("string")))


def unsupported_share(said: Column, known: Column) -> Column:
    """Share of the items, repeats counted, that aren't among the known ones; 0 without items."""

    def of(s: Column) -> Column:  # the items that are known are found by hashing, and are few
        missing = let(F.array_intersect(s, known), lambda both: F.size(F.filter(s, lambda x: ~F.array_contains(both, x))))
        return F.when(F.size(s) == 0, 0.0).otherwise(missing / F.size(s))

    return let(said, of)


def clauses(text: Column) -> Column:
    return found(text, CLAUSE, 1)


def question_drift(question: Column, answer: Column) -> Column:
    share = lambda asked: F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_except(asked, content_words(answer))) / F.size(asked))
    return let(F.array_distinct(content_words(question)), share)


def hedge_density(answer: Column) -> Column:
    hedges = _lits(HEDGES)
    return F.least(F.lit(1.0), F.size(F.filter(words(answer), lambda w: F.array_contains(hedges, w))) / 3.0)


def claim_bearing(sentence: Column) -> Column:
    text = F.trim(sentence)
    opens = reduce(lambda a, b: a | b, [F.startswith(F.lower(text), F.lit(p)) for p in PROCEDURAL])
    return F.when(text == "", False).when(F.size(found(text, FIGURE, 1)) + F.size(clauses(text)) > 0, True).when(F.endswith(text, F.lit("?")) | opens, False).otherwise(F.size(words(text)) >= 4)


#: Fixed value: what stands between two claims of a sentence.
BETWEEN_CLAIMS = r"(?i)\s*;\s*|\s+(?:and|but)\s+(?=(?:the|it|this|that|there|a|an|you|we|they|[A-Z0-9]))|\s+(?:however|whereas|although)\s+"


def claim_spans(sentence: Column, least: int = 25) -> Column:
    """(start, end) of each claim of a sentence of at least so many characters; the whole sentence if there is none.

    Parts and what separates them are folded from left to right: a part that is too short grows by what follows it.
    """
    parts, between = F.split(sentence, BETWEEN_CLAIMS), F.concat(found(sentence, BETWEEN_CLAIMS), F.array(F.lit("")))
    lengths = F.zip_with(parts, between, lambda p, b: F.struct(F.length(p).alias("part"), F.length(b).alias("gap")))
    spans = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("place"), F.lit(0).alias("open"), spans.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["place"] + x["part"]
        long_enough = end - acc["open"] >= least
        return F.struct(
            (end + x["gap"]).alias("place"), F.when(long_enough, end + x["gap"]).otherwise(acc["open"]).alias("open"),
            F.when(long_enough, F.concat(acc["spans"], F.array(F.struct(acc["open"].alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        )

    whole = F.when(F.trim(sentence) != "", F.array(F.struct(F.lit(0).alias("start"), F.length(sentence).alias("end")))).otherwise(spans)
    return let(F.aggregate(lengths, start, step, lambda acc: acc["spans"]), lambda s: F.when(F.size(s) > 0, s).otherwise(whole))


def grounding(answer: Column, context: Column, question: Column) -> Column:
    """Six raw signals of one sentence; one that claims nothing has only its overconfidence."""

    def signals(claims: Column) -> Column:
        only = lambda c: F.when(claims, c).otherwise(0.0)
        return F.struct(
            only(unsupported_content(answer, context)).alias("unsupported_content"), only(unsupported_share(figures(answer), figures(context))).alias("numeric_unsupported"),
            only(unsupported_share(clauses(answer), clauses(context))).alias("citation_unsupported"), (1 - hedge_density(answer)).alias("overconfidence"),
            only(question_drift(question, answer)).alias("question_drift"), claims.alias("claim_bearing"),
        )

    return let(claim_bearing(answer), signals)


def session_similarity(a: Column, b: Column) -> Column:
    """Cosine of two sets of session words, at most 1; 0 if either is empty."""
    stop = _lits(SESSION_STOP)
    of = lambda t: F.array_distinct(F.filter(found(F.lower(t), "[a-z0-9]+"), lambda w: ~F.array_contains(stop, w)))
    x, y = of(a), of(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.least(F.lit(1.0), F.size(F.array_intersect(x, y)) / F.sqrt(F.size(x).cast("double") * F.size(y)))).otherwise(0.0)


def injection(text: Column) -> Column:
    """Score of the worst rule that matches, and 0.05 more for every further reason, at most 1; 0 for null."""

    def reasons(t: Column) -> Column:
        """Weights of the rules that match; t has the text, what shows of it, and both in lower case."""
        holds = lambda side, name: reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [F.contains(t[side], F.lit(k)) for k in group]) for group in NEEDED[name]])
        rule = lambda side, name, pattern, weight: F.when(holds(f"{side}_low", name) & t[side].rlike("(?i)" + pattern), F.lit(weight))
        rules = [*[rule("shown", *r) for r in INJECTION], *[rule("text", *r) for r in HIDDEN], F.when(F.length(t["shown"]) < F.length(t["text"]), F.lit(0.7))]
        return F.array_compact(F.array(*rules))

    def worst(weights: Column) -> Column:
        top = F.coalesce(F.array_max(weights), F.lit(0.0))
        return F.when(F.size(weights) > 1, F.least(F.lit(1.0), top + 0.05 * (F.size(weights) - 1))).otherwise(top)

    both = lambda shown: F.struct(text.alias("text"), shown.alias("shown"), F.lower(text).alias("text_low"), F.lower(shown).alias("shown_low"))
    score = let(let(let(F.translate(text, INVISIBLE, ""), both), reasons), worst)
    return F.when(text.isNull() | (text == ""), 0.0).otherwise(score)


def relabelled(provenance: Column, score: Column, limit: float = 0.6) -> Column:
    return F.when((score >= limit) & (provenance != "system"), "retrieved_untrusted").otherwise(provenance)


def luhn_ok(digits: Column) -> Column:
    """Luhn's check over at least 12 digits."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return digits.rlike("^[0-9]{12,}$") & (F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0)


def _dihedral() -> list[int]:
    """The product table of the dihedral group of ten elements, row by row."""
    rotate = lambda a, b: (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    flip = lambda a, b: 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5
    return [rotate(a, b) if a < 5 else flip(a, b) for a in range(10) for b in range(10)]


def _permutations() -> list[int]:
    """Eight powers of Verhoeff's permutation, row by row."""
    base, rows = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4), [tuple(range(10))]
    for _ in range(7):
        rows.append(tuple(base[x] for x in rows[-1]))
    return [x for row in rows for x in row]


def verhoeff_ok(digits: Column) -> Column:
    d, p = _lits(_dihedral()), _lits(_permutations())
    seen = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.element_at(p, (i % 8) * 10 + c.cast("int") + 1))
    return digits.rlike("^[0-9]+$") & (F.aggregate(seen, F.lit(0), lambda a, x: F.element_at(d, a * 10 + x + 1)) == 0)


def without_secrets(text: Column) -> Column:
    text = F.regexp_replace(text, r"\bsk-(?:or-v1-)?[A-Za-z0-9_-]{8,}\b", "[REDACTED-API-KEY]")
    text = F.regexp_replace(text, r"(?i)\bbearer\s+[A-Za-z0-9._~-]{8,}", "Bearer [REDACTED]")
    return F.regexp_replace(text, r"(?i)\bIL-CANARY-[A-Za-z0-9_-]+\b", "[REDACTED-CANARY]")


def softened(text: Column) -> Column:
    for phrase in sorted(SOFTER, key=len, reverse=True):
        text = F.regexp_replace(text, rf"(?i)\b{phrase}\b", SOFTER[phrase])
    return text


def appended(text: Column, suffix: str | Column) -> Column:
    """The suffix before the marks that end the text."""
    suffix = F.lit(suffix) if isinstance(suffix, str) else suffix
    body, marks = F.regexp_replace(text, r"([.!?]+[\"')\]]*)$", ""), F.regexp_extract(text, r"([.!?]+[\"')\]]*)$", 1)
    return F.concat(body, F.lit(" "), suffix, marks)


def annotated(text: Column, p_overconfident: Column, p_unverified: Column, citation: Column) -> Column:
    out = F.when(p_overconfident >= 0.30, softened(text)).otherwise(text)
    out = F.when((citation != "") & ~F.contains(out, citation), appended(out, citation)).otherwise(out)
    return F.when((p_unverified >= 0.30) & ~F.contains(out, F.lit(UNVERIFIED)), appended(out, UNVERIFIED)).otherwise(out)


def decision_fields(text: Column) -> Column:
    """approved (a refusal wins, null if neither), sorted percentages, hedges."""
    approved = F.when(text.rlike(REFUSE), False).when(text.rlike(APPROVE), True)
    percents = F.array_sort(F.transform(found(text, r"([0-9]+(?:\.[0-9]+)?)\s*%", 1), lambda x: x.cast("double")))
    return F.struct(approved.alias("approved"), percents.alias("percentages"), F.size(found(text, HEDGED)).alias("hedges"))


def largest_amount(text: Column) -> Column:
    """The largest rupee amount, lakhs and crores scaled; 0 if none."""
    scaled = F.transform(found(text, r"(?i)([0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:lakhs?|lac)\b", 1), lambda x: F.regexp_replace(x, ",", "").cast("double") * 100_000)
    crores = F.transform(found(text, r"(?i)([0-9][0-9,]*(?:\.[0-9]+)?)\s*crores?\b", 1), lambda x: F.regexp_replace(x, ",", "").cast("double") * 10_000_000)
    before = F.transform(found(text, r"(?i)(?:rs\.?|inr|₹)\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)", 1), lambda x: F.regexp_replace(x, ",", "").cast("double"))
    after = F.transform(found(text, r"(?i)([0-9][0-9,]*(?:\.[0-9]{1,2})?)\s*(?:rupees|rs\.?|inr)\b", 1), lambda x: F.regexp_replace(x, ",", "").cast("double"))
    return F.coalesce(F.array_max(F.concat(scaled, crores, before, after)), F.lit(0.0))


def intent(text: Column) -> Column:
    """The domain with most keywords, ties to the first; general if none."""
    scores = [(d, sum((F.contains(F.lower(text), F.lit(k)).cast("int") for k in ks), F.lit(0))) for d, ks in INTENT.items()]
    best = F.greatest(*[s for _, s in scores])
    out = F.when(best == 0, "general")
    for d, s in scores:
        out = out.when(s == best, d)
    return out


def difficulty(question: Column, retrieved_nothing: Column) -> Column:
    n = F.size(F.filter(F.split(question, r"\s+"), lambda w: w != ""))
    return F.greatest(F.when(retrieved_nothing, 1.0).otherwise(0.0), F.least(F.lit(1.0), n / 60.0), *[F.when(question.rlike(p), w).otherwise(0.0) for p, w in HARD])


def swapped(text: Column, a: str, b: str) -> Column:
    return F.regexp_replace(text, f"(?i){a}", b)


def rupees(amount: Column) -> Column:
    """Whole rupees in Indian grouping: the last three digits, then pairs."""
    digits = F.abs(amount).cast("long").cast("string")
    head, tail = F.substring(digits, 1, F.length(digits) - 3), F.right(digits, F.lit(3))
    grouped = F.when(F.length(digits) <= 3, digits).otherwise(F.concat(F.regexp_replace(head, r"([0-9])(?=(?:[0-9]{2})+$)", "$1,"), F.lit(","), tail))
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("₹"), grouped)
