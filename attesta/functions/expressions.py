"""Scalar rules as column expressions: they stay in the JVM and inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pseudo-counts: reliability of an unknown source, its sensitivity and its false-positive rate.
RELIABILITY_PRIOR, SENS_PRIOR, FPR_PRIOR = (19.0, 1.0), (9.5, 0.5), (0.5, 9.5)
EPSILON = 1e-9
DAY_MS = 86_400_000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def actor_class(actor: Column | str) -> Column:
    """human, tool, agent or verifier from the prefix before the colon; agent otherwise."""
    head = F.substring_index(_c(actor), ":", 1)
    named = (F.instr(_c(actor), ":") > 0) & head.isin("human", "tool", "agent", "verifier")
    return F.coalesce(F.when(named, head), F.lit("agent"))


def quota_epoch(ts_ms: Column | str) -> Column:
    """Number of the UTC day."""
    return F.floor(_c(ts_ms) / DAY_MS).cast("long")


def confidence_grade(confidence: Column | str) -> Column:
    """0 without a confidence, else 1 to 3 by how far it is from even."""
    c = _c(confidence)
    strength = F.greatest(c, 1 - c)
    return F.when(c.isNull(), 0).when(strength < 0.75, 1).when(strength < 0.9, 2).otherwise(3)


def sensitivity(tp: Column | str, fn: Column | str) -> Column:
    return (SENS_PRIOR[0] + _c(tp)) / (sum(SENS_PRIOR) + _c(tp) + _c(fn))


def false_positive_rate(fp: Column | str, tn: Column | str) -> Column:
    return (FPR_PRIOR[0] + _c(fp)) / (sum(FPR_PRIOR) + _c(fp) + _c(tn))


def vote_log_lr(sens: Column, fpr: Column, vote: Column) -> Column:
    """What a yes or no of this source says, in nats."""
    clip = lambda x: F.least(F.lit(1 - EPSILON), F.greatest(F.lit(EPSILON), x))
    s, f = clip(sens), clip(fpr)
    return F.when(vote, F.ln(s / f)).otherwise(F.ln((1 - s) / (1 - f)))


def temper(log_lr: Column, weight: Column) -> Column:
    return log_lr * F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))))


def surprisal(p: Column, outcome: Column) -> Column:
    """Nats of the outcome under p."""
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    return -F.ln(F.when(outcome, q).otherwise(1 - q))


def bucket(p: Column | str, buckets: int = 10) -> Column:
    return F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(_c(p) * buckets).cast("int")))


def breadth_class(breadth: Column | str) -> Column:
    return F.when(_c(breadth) < 0.34, "narrow").when(_c(breadth) < 0.67, "moderate").otherwise("broad")


def transferability(confidence: Column, breadth: Column) -> Column:
    cap = F.when(breadth == "narrow", 0.5).when(breadth == "moderate", 0.8).otherwise(1.0)
    return F.least(confidence, cap)


def direction_evidence(right: Column, wrong: Column) -> Column:
    """Signed nats by which hits and misses speak for a direction, against a coin."""
    n = right + wrong
    p = (right + 0.5) / (n + 1.0)
    llr = right * F.ln(2 * p) + wrong * F.ln(2 * (1 - p))
    return F.when(n == 0, 0.0).when(right >= wrong, llr).otherwise(-llr)


def demotion_warranted(admission: Column, against: Column) -> Column:
    return against > admission + F.ln(F.lit(3.0))


def description_bits(n: Column, k: Column) -> Column:
    """Code length of k successes in n at the smoothed rate; 0 for an empty group."""
    p = (k + 0.5) / (n + 1.0)
    return F.when(n == 0, 0.0).otherwise(-(k * F.log2(p) + (n - k) * F.log2(1 - p)))


def guard_holds(value: Column, op: str, against: str | float) -> Column:
    """A comparison on a bound variable: numeric where the operator needs it; false for whatever is missing or no number."""
    if op in ("==", "!="):
        same = value == F.lit(str(against))
        return F.coalesce(same if op == "==" else ~same, F.lit(False))
    left = value.try_cast("double")
    right = F.lit(float(against))
    return F.coalesce({"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op], F.lit(False))


def clock(ts_ms: Column | str) -> tuple[Column, Column]:
    """(UTC hour as HH, Monday-based day of week as text)."""
    t = F.timestamp_millis(_c(ts_ms))
    return F.date_format(t, "HH"), F.weekday(t).cast("string")


def posterior_mean(k: Column | str, n: Column | str, a: float = 1.0, b: float = 1.0) -> Column:
    return (_c(k) + a) / (_c(n) + a + b)


def span_ref(entry: Column, content_hash: Column, offset: Column) -> Column:
    return F.concat_ws("|", entry, content_hash, offset.cast("string"))


def content_hash(text: Column | str) -> Column:
    return F.substring(F.sha2(_c(text).cast("binary"), 256), 1, 32)


def plain(text: Column | str) -> Column:
    """Lower case, with white space as single spaces and none at the ends."""
    return F.lower(F.trim(F.regexp_replace(_c(text), r"\s+", " ")))


def holds_span(text: Column | str, span: Column | str, least: int = 20) -> Column:
    """Whether a span, plain and of at least so many characters, is in a text."""
    needle = plain(span)
    return (F.length(needle) >= least) & F.contains(plain(text), needle)


def longest_shared(a: Column, b: Column, most: int = 24) -> Column:
    """Length of the longest run of tokens, up to most, that two arrays of tokens share."""
    grams = lambda x, n: F.when(F.size(x) >= n, F.transform(F.sequence(F.lit(1), F.size(x) - n + 1), lambda i: F.array_join(F.slice(x, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.array_max(F.array(*[F.when(F.arrays_overlap(grams(a, n), grams(b, n)), n).otherwise(0) for n in range(1, most + 1)])), F.lit(0))


def in_training(key: Column | str, salt: str = "20260725", percent: int = 50) -> Column:
    """A fixed split by a hash of salt and key: true for about percent of 100."""
    word = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), _c(key).cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return word % 100 < percent


def shifted_number(text: Column | str, factor: float) -> Column:
    """text with its first number other than 0 and 1 times factor, to as many decimals; null if there is none or nothing changes."""
    number = F.regexp_extract(_c(text), r"(?<![\d.])(?!(?:0|1)(?![\d.]))(\d+(?:\.\d+)?)", 1)
    decimals = F.length(F.regexp_extract(number, r"\.(\d+)$", 1))
    value = number.try_cast("double") * factor
    made = F.when(decimals == 0, F.bround(value).cast("long").cast("string"))
    for d in range(1, 7):
        made = F.when(decimals == d, F.format_string(f"%.{d}f", value)).otherwise(made)
    at = F.instr(_c(text), number)
    out = F.concat(F.substring(_c(text), F.lit(1), at - 1), made, F.substring(_c(text), at + F.length(number), F.length(_c(text))))
    return F.when((number != "") & (made != number), out)


def negated(text: Column | str) -> Column:
    """text with its first auxiliary verb negated; null if it has none that isn't already."""
    pattern = r"(?i)\b(is|are|was|were|can|will|should|must|does|has)\b(?! not\b|n't)"
    return F.when(_c(text).rlike(pattern), F.regexp_replace(_c(text), r"(?is)^(.*?)\b(is|are|was|were|can|will|should|must|does|has)\b(?! not\b|n't)", "$1$2 not"))


def swapped(text: Column, own: Column, other: Column) -> Column:
    """text with the first own, in any case, as other; null without one."""
    at = F.instr(F.lower(text), F.lower(own))
    return F.when((at > 0) & (F.lower(own) != F.lower(other)), F.concat(F.substring(text, F.lit(1), at - 1), other, F.substring(text, at + F.length(own), F.length(text))))
