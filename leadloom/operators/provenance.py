"""What repeat sightings add, how tiers and reason codes are shown, and headline figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def new_provenance(repeats: DataFrame, stored: DataFrame, keys: list[str], lists: list[str]) -> DataFrame:
    """Repeat sightings with a term, in any of their lists, that the stored sightings of the key do not have.

    A null list is empty; a key that is not stored has nothing but new terms.
    Stored terms of a key are a set, bounded by the vocabulary.
    """
    empty = F.array().cast("array<string>")
    seen = stored.groupBy(*keys).agg(*[F.array_distinct(F.flatten(F.collect_set(F.coalesce(x, empty)))).alias(f"__{x}") for x in lists])
    fresh = [F.size(F.array_except(F.coalesce(x, empty), F.coalesce(f"__{x}", empty))) > 0 for x in lists]
    return repeats.join(seen, keys, "left").where(reduce(lambda a, b: a | b, fresh)).select(*repeats.columns)


def linked_repeats(repeats: DataFrame, known: DataFrame) -> DataFrame:
    """Repeats with the company_id that the first resolved sighting of their key is known by; those of unresolved keys are left out.

    ``known`` has provider_id, external_id, candidate_id and company_id.
    """
    first = known.where("company_id is not null").groupBy("provider_id", "external_id").agg(F.min_by("company_id", "candidate_id").alias("company_id"))
    return repeats.join(first, ["provider_id", "external_id"])


# What reviewers read for a reason code, and which codes speak for and against a lead.
LABELS = {
    "HARD_RULE_FAIL": "Fails a hard requirement", "HARD_RULE_HOLD": "Hard requirement unresolved", "HARD_RULE_PASS": "Meets all hard requirements", "HARD_RULE_UNKNOWN": "Hard requirement result unknown",
    "HUMAN_ACCEPTED": "Accepted by reviewer", "HUMAN_REJECTED": "Rejected by reviewer", "HUMAN_HELD": "Held by reviewer", "HUMAN_DUPLICATE": "Marked duplicate by reviewer",
    "QUALIFICATION_GOOD_FIT": "Strong overall fit", "QUALIFICATION_WEAK_FIT": "Some fit, weaker signal", "QUALIFICATION_NOT_FIT": "Not a fit", "QUALIFICATION_HOLD": "Qualification held",
    "QUALIFICATION_MISSING": "Not yet qualified", "ADVERSARIAL_SURVIVES": "Fit confirmed under review", "ADVERSARIAL_WEAKENED": "Fit weakened under review", "ADVERSARIAL_DISPROVED": "Fit disproved under review",
    "ADVERSARIAL_HOLD": "Adversarial review held", "ADVERSARIAL_MISSING": "Not yet adversarially reviewed", "SCORE_MISSING": "Not yet scored", "EVIDENCE_CONFLICTS_PRESENT": "Conflicting evidence present",
    "VERIFICATION_UNRESOLVED": "Verification unresolved", "TIE_BROKEN_BY_EVIDENCE_SCORE": "Tie broken by evidence strength", "TIE_BROKEN_BY_LEAD_ID": "Tie broken by lead id",
}
MET = ("HARD_RULE_PASS", "HUMAN_ACCEPTED", "QUALIFICATION_GOOD_FIT", "QUALIFICATION_WEAK_FIT", "ADVERSARIAL_SURVIVES")
NOT_MET = ("HARD_RULE_FAIL", "HUMAN_REJECTED", "HUMAN_DUPLICATE", "QUALIFICATION_NOT_FIT", "ADVERSARIAL_DISPROVED", "EVIDENCE_CONFLICTS_PRESENT")


def reason_label(code: Column) -> Column:
    """What reviewers read; a code without a label is shown as it is."""
    return F.coalesce(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p])[code], code)


def reason_sentiment(code: Column) -> Column:
    return F.when(code.isin(*MET), "met").when(code.isin(*NOT_MET), "not_met").otherwise("unknown")


def display_tier(tier: Column) -> Column:
    """What reviewers see of the seven tiers."""
    return F.when(tier.isin("ACCEPTED", "QUALIFIED_STRONG"), "strong").when(tier == "QUALIFIED_WEAK", "good").when(tier == "HARD_FAILED", "rejected").otherwise("weak")


def headline(leads: DataFrame, key: str) -> DataFrame:
    """For each key of ``leads`` (company_id, tier): companies found, and leads worth a review."""
    shown = display_tier(F.col("tier"))
    return leads.groupBy(key).agg(F.count_distinct("company_id").alias("total_found"), F.count(F.when(shown.isin("strong", "good"), 1)).alias("qualified_found"))


def quality_figures(leads: DataFrame, key: str) -> DataFrame:
    """For each key the shares that count; null without a base.

    ``leads`` has outcome, feedback, human_review_decision and completeness.
    Of accepted leads: those that feedback confirms as good fits, and those it
    marks as no fits. Completeness: the mean over accepted and held leads.
    Duplicates: of all. Overrides: of all decisions to accept, hold or reject,
    those that a review changed.
    """
    c = F.col
    n = lambda cond: F.count(F.when(cond, 1))
    accepted, decided = c("outcome") == "ACCEPTED", c("outcome").isin("ACCEPTED", "HELD", "REJECTED")
    said = F.create_map(F.lit("ACCEPTED"), F.lit("ACCEPT"), F.lit("HELD"), F.lit("HOLD"), F.lit("REJECTED"), F.lit("REJECT"))[c("outcome")]
    return leads.groupBy(key).agg(
        F.try_divide(n(accepted & (c("feedback") == "GOOD_FIT")), n(accepted)).alias("good_fit_precision"), F.try_divide(n(accepted & (c("feedback") == "NOT_FIT")), n(accepted)).alias("false_positive_rate"),
        F.avg(F.when(c("outcome").isin("ACCEPTED", "HELD"), c("completeness"))).alias("evidence_completeness"), F.try_divide(n(c("outcome") == "DUPLICATE"), F.count("*")).alias("duplicate_rate"),
        F.try_divide(n(decided & (c("human_review_decision") != said)), n(decided)).alias("override_rate"),
    )


def within_bounds(counts: DataFrame) -> DataFrame:
    """Adds consistent: whether a batch's outcomes are no more than what it researched."""
    total = F.col("n_accepted") + F.col("n_held") + F.col("n_rejected") + F.col("n_duplicate")
    return counts.withColumn("consistent", total <= F.col("n_items"))
