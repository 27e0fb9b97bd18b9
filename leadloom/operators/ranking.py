"""Latest rows, tiers and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import lean_numbered

# Tiers from best to worst, and the four that reviewers see.
TIERS = ("ACCEPTED", "QUALIFIED_STRONG", "QUALIFIED_WEAK", "HOLD", "REJECTED", "DUPLICATE", "HARD_FAILED")


def latest(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The newest row of each key; of equal times the greatest tie column. An aggregate, so it shrinks before it shuffles."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("__top"))
    return top.select(*keys, *[F.col(f"__top.{c}").alias(c) for c in rest])


def tier() -> Column:
    """First match wins; a hard FAIL comes before everything else."""
    c = F.col
    return (
        F.when(c("hard_rule_result") == "FAIL", "HARD_FAILED").when(c("batch_outcome") == "DUPLICATE", "DUPLICATE")
        .when(c("human_review_decision") == "REJECT", "REJECTED").when(c("human_review_decision") == "ACCEPT", "ACCEPTED")
        .when(c("human_review_decision") == "HOLD", "HOLD").when(c("human_review_decision") == "DUPLICATE", "DUPLICATE")
        .when(c("hard_rule_result").isNull() | (c("hard_rule_result") == "HOLD"), "HOLD").when(c("adversarial_result") == "DISPROVED", "REJECTED")
        .when(c("qualification_decision") == "NOT_FIT", "REJECTED").when(c("qualification_decision").isNull() | (c("qualification_decision") == "HOLD"), "HOLD")
        .when(c("adversarial_result") == "HOLD", "HOLD")
        .when((c("qualification_decision") == "GOOD_FIT") & (F.coalesce(c("adversarial_result"), F.lit("")) != "WEAKENED"), "QUALIFIED_STRONG")
        .otherwise("QUALIFIED_WEAK")
    )


def tier_index(tier: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, t in enumerate(TIERS) for x in (F.lit(t), F.lit(k))]), tier)


def tier_reasons() -> Column:
    """Why a lead is in its tier, in the order of judgement, and what else is missing or open; takes the columns of :func:`tier` and more scores and flags."""
    c = F.col
    hard, human, fit, adv = c("hard_rule_result"), c("human_review_decision"), c("qualification_decision"), c("adversarial_result")
    one = lambda x: F.array(F.lit(x))
    passed = lambda *x: F.array_compact(F.array(F.lit("HARD_RULE_PASS"), *x))
    survived = F.when(adv == "SURVIVES", "ADVERSARIAL_SURVIVES").when(adv == "WEAKENED", "ADVERSARIAL_WEAKENED").when(adv.isNull(), "ADVERSARIAL_MISSING")
    main = (
        F.when(hard == "FAIL", one("HARD_RULE_FAIL")).when(c("batch_outcome") == "DUPLICATE", one("HUMAN_DUPLICATE")).when(human == "REJECT", one("HUMAN_REJECTED"))
        .when(human == "ACCEPT", one("HUMAN_ACCEPTED")).when(human == "HOLD", one("HUMAN_HELD")).when(human == "DUPLICATE", one("HUMAN_DUPLICATE"))
        .when(hard == "HOLD", one("HARD_RULE_HOLD")).when(hard.isNull(), one("HARD_RULE_UNKNOWN")).when(adv == "DISPROVED", passed(F.lit("ADVERSARIAL_DISPROVED")))
        .when(fit == "NOT_FIT", passed(F.lit("QUALIFICATION_NOT_FIT"))).when(fit.isNull(), passed(F.lit("QUALIFICATION_MISSING"))).when(fit == "HOLD", passed(F.lit("QUALIFICATION_HOLD")))
        .when(adv == "HOLD", passed(F.lit("ADVERSARIAL_HOLD"))).otherwise(passed(F.when(fit == "GOOD_FIT", "QUALIFICATION_GOOD_FIT").otherwise("QUALIFICATION_WEAK_FIT"), survived))
    )
    more = F.array_compact(F.array(
        F.when(c("final_score").isNull() & (hard == "PASS"), "SCORE_MISSING"), F.when(c("company_quality_score").isNull() & hard.isin("PASS", "HOLD"), "COMPANY_QUALITY_MISSING"),
        F.when(c("evidence_has_conflicts"), "EVIDENCE_CONFLICTS_PRESENT"), F.when(c("verification_unresolved"), "VERIFICATION_UNRESOLVED"),
    ))
    return F.concat(main, more)


def rank_leads(signals: DataFrame, scores: list[str], lead: str = "lead_id", icp: str = "icp_id") -> DataFrame:
    """tier and position (1..n in each profile): by tier, then the scores in order, null last, then the lead's id."""
    order = [tier_index(F.col("tier")), *[F.coalesce(F.col(s), F.lit(-1.0)).desc() for s in scores], F.col(lead)]
    return lean_numbered(signals.withColumn("tier", tier()), [icp], order, "position")
