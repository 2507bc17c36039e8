"""Column functions of verdicts on evidence: conflicts, validity of policies, freshness, consistency, the final result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A quote of a claim has this many characters at least.
QUOTE = 12


def conflicting(quote: Column, positive: list[str], negative: list[str]) -> Column:
    """Aggregate: whether the quotes of a group have both a positive and a negative term; a negative term hides the positive one inside it."""
    low = F.lower(F.coalesce(quote, F.lit("")))
    rest = low
    for term in negative:
        rest = F.replace(rest, F.lit(term), F.lit(" "))

    def has(text: Column, terms: list[str]) -> Column:
        return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))

    return F.bool_or(has(rest, positive)) & F.bool_or(has(low, negative))


def policy_validity(expires: Column, review_due: Column, as_of: Column) -> Column:
    """EXPIRED, REVIEW_OVERDUE, CURRENT, or UNKNOWN where neither date is known; dates are dates."""
    return F.when(expires < as_of, "EXPIRED").when(review_due < as_of, "REVIEW_OVERDUE").when(F.coalesce(expires, review_due).isNotNull(), "CURRENT").otherwise("UNKNOWN")


def evidence_freshness(seen: Column, cadence_days: Column, as_of: Column) -> Column:
    """STALE or CURRENT by the stated cadence; UNKNOWN without a cadence or a date."""
    return F.when(cadence_days.isNull() | seen.isNull(), "UNKNOWN").when(F.date_diff(as_of, seen) > cadence_days, "STALE").otherwise("CURRENT")


def consistent_status(status: Column, quote: Column) -> Column:
    """``status``, but NON_COMPLIANT where a COMPLIANT one has no quote of QUOTE characters."""
    short = F.char_length(F.trim(F.coalesce(quote, F.lit("")))) < QUOTE
    return F.when((status == "COMPLIANT") & short, "NON_COMPLIANT").otherwise(status)


def final_result(support: Column, conflict: Column, validity: Column, freshness: Column) -> Column:
    """Aggregate: COMPLIANT where every requirement of a group is supported, quotes don't conflict, its policy is CURRENT and no evidence is STALE."""
    ok = F.bool_and(F.coalesce(support == "SUPPORTED", F.lit(False))) & ~conflict & F.bool_and(F.coalesce(validity == "CURRENT", F.lit(False))) & F.bool_and(F.coalesce(freshness != "STALE", F.lit(False)))
    return F.when(ok, "COMPLIANT").otherwise("NON_COMPLIANT")
