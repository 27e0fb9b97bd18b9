"""Scores of leads and companies, from rule results, evidence summaries and resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import preference_term
from .evidence import COMPANY_CRITICAL, PERSON_CRITICAL
from .signals import MODELS, SIGNALS

# Weights of the final score and of company quality, and the middle of the scale.
WEIGHTS = {"icp": 0.40, "commercial": 0.30, "evidence": 0.15, "identity": 0.05, "freshness": 0.10}
NEUTRAL = 50.0
STRONG = 70.0


def clamp(c: Column) -> Column:
    """Between 0 and 100; null stays null, which greatest and least alone would skip."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), c)))


def icp_score(results: Column) -> Column:
    """Share of the configured rules that pass, in percent; 100 if none is configured."""
    configured = F.size(F.filter(results, lambda r: r["status"] != "NOT_APPLICABLE"))
    passed = F.size(F.filter(results, lambda r: r["status"] == "PASS"))
    return F.when(configured == 0, 100.0).otherwise(100.0 * passed / configured)


def final_score(hard: Column, icp: Column, commercial: Column, evidence: Column, identity: Column, freshness: Column) -> Column:
    """The weighted mean, of leads whose hard result is PASS only; an unknown freshness takes its weight with it, any other unknown part leaves no score."""
    w = WEIGHTS
    known = w["icp"] * icp + w["commercial"] * commercial + w["evidence"] * evidence + w["identity"] * identity
    base = w["icp"] + w["commercial"] + w["evidence"] + w["identity"]
    return F.when(hard == "PASS", clamp(F.when(freshness.isNull(), known / base).otherwise((known + w["freshness"] * freshness) / (base + w["freshness"]))))


def identity_confidence(resolutions: DataFrame, key: str) -> DataFrame:
    """One row a key: 40 with any conflict, 100 with any HIGH, 75 with any NEW, else 50. Takes has_conflict, confidence, status; nulls count as false."""
    told = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    score = F.when(told(F.col("has_conflict")), 40.0).when(told(F.col("confidence") == "HIGH"), 100.0).when(told(F.col("status") == "NEW"), 75.0).otherwise(NEUTRAL)
    return resolutions.groupBy(key).agg(score.alias("identity_confidence"))


def mean_identity(leads: DataFrame, companies: DataFrame, people: DataFrame) -> DataFrame:
    """(lead_id, identity_confidence): the mean of what is known of a lead's company and person, 50 if neither is.

    ``companies`` and ``people`` are :func:`identity_confidence` by company_id and person_id.
    """
    of = lambda df, key, name: df.select(key, F.col("identity_confidence").alias(name))
    rows = leads.join(of(companies, "company_id", "c"), "company_id", "left").join(of(people, "person_id", "p"), "person_id", "left")
    mean = F.when(F.col("c").isNotNull() & F.col("p").isNotNull(), (F.col("c") + F.col("p")) / 2).otherwise(F.coalesce("c", "p", F.lit(NEUTRAL)))
    return rows.select("lead_id", clamp(mean).alias("identity_confidence"))


def commercial_score(wanted: DataFrame, models: DataFrame, signals: DataFrame) -> DataFrame:
    """How far a company meets what a profile wishes: (icp_id, company_id, commercial_score).

    ``wanted`` has icp_id, company_id and terms (array); ``models`` and
    ``signals`` are those of :mod:`signals`. Terms outside both vocabularies
    are left out, and 50 stands where no term remains.
    """
    vocabulary = [*MODELS, "HYBRID", "UNKNOWN"]
    terms = wanted.select("icp_id", "company_id", F.explode_outer("terms").alias("raw")).withColumn("term", preference_term(F.trim("raw"))).drop("raw")
    own = models.select("company_id", "primary", "models", F.col("status").alias("model_status"))
    seen = signals.select("company_id", F.col("signal").alias("term"), F.col("status").alias("signal_status"))
    rows = terms.join(own, "company_id", "left").join(seen, ["company_id", "term"], "left")
    # A single model is the primary one; with several, HYBRID and each of them are met.
    met = F.array_contains("models", F.col("term")) | (F.col("primary") == F.col("term"))
    by_model = F.when(F.col("model_status") == "CLASSIFIED", F.when(met, 100.0).otherwise(0.0)).when(F.col("model_status") == "CONFLICTING_EVIDENCE", 20.0).otherwise(0.0)
    by_signal = F.when(F.col("signal_status") == "SUPPORTED", 100.0).when(F.col("signal_status") == "INSUFFICIENT", 55.0).when(F.col("signal_status") == "CONFLICT", 20.0)
    points = (
        F.when(F.col("model_status").isNotNull() & F.col("term").isin(vocabulary), by_model).when(F.col("signal_status").isNotNull(), by_signal)
        .when(F.col("term").isin(list(SIGNALS)), 0.0)
    )
    return rows.groupBy("icp_id", "company_id").agg(F.coalesce(F.avg(points), F.lit(NEUTRAL)).alias("commercial_score"))


def evidence_score(
    leads: DataFrame, status: DataFrame, models: DataFrame, signals: DataFrame, company: tuple[str, ...] = COMPANY_CRITICAL, person: tuple[str, ...] = PERSON_CRITICAL,
    identity_fields: tuple[str, ...] = ("company_identity", "domain"), person_identity: str = "person_identity",
) -> DataFrame:
    """(lead_id, evidence_score): the mean of coverage, freedom from conflict, corroboration, identity, model and signals, each of 100.

    ``leads`` has lead_id, company_id and person_id (null: none). ``status``
    is that of ``evidence.field_status`` of companies and people; ``models``
    and ``signals`` have company_id. With a person, coverage is the mean of
    both, and shares go over the fields of both. Without evidence a lead is
    free of conflict and all else is 0.
    """
    c, zero = F.col, F.lit(0)
    n = lambda cond: F.count(F.when(cond, 1))
    per = status.groupBy("entity_type", "entity_id").agg(
        F.count("*").alias("fields"), n(c("status") != "CONFLICT").alias("agreed"), n(c("corroborated")).alias("backed"),
        n(F.when(c("entity_type") == "PERSON", c("field").isin(*person)).otherwise(c("field").isin(*company))).alias("covered"),
        n(F.when(c("entity_type") == "PERSON", c("field") == person_identity).otherwise(c("field").isin(*identity_fields))).alias("known"),
    )
    sums = ("fields", "agreed", "backed", "covered", "known")
    side = lambda kind, key, tag: per.where(c("entity_type") == kind).select(c("entity_id").alias(key), *[c(s).alias(f"{s}_{tag}") for s in sums])
    model = models.select("company_id", F.when(c("status") == "CLASSIFIED", 100.0).otherwise(30.0).alias("model"))
    some = signals.select("company_id").distinct().withColumn("signal", F.lit(100.0))
    rows = leads.join(side("COMPANY", "company_id", "c"), "company_id", "left").join(side("PERSON", "person_id", "p"), "person_id", "left").join(model, "company_id", "left").join(some, "company_id", "left")
    both = lambda s: F.coalesce(f"{s}_c", zero) + F.coalesce(f"{s}_p", zero)
    of_company, of_person = F.coalesce("covered_c", zero) / len(company), F.coalesce("covered_p", zero) / len(person)
    coverage = F.when(c("person_id").isNull(), 100.0 * of_company).otherwise(100.0 * (of_company + of_person) / 2)
    some_fields = both("fields") > 0
    parts = (
        coverage, F.when(some_fields, 100.0 * both("agreed") / both("fields")).otherwise(100.0), F.when(some_fields, 100.0 * both("backed") / both("fields")).otherwise(0.0),
        F.when(both("known") > 0, 100.0).otherwise(0.0), F.coalesce("model", F.lit(0.0)), F.coalesce("signal", F.lit(0.0)),
    )
    return rows.select("lead_id", clamp(sum(parts[1:], parts[0]) / len(parts)).alias("evidence_score"))


def quality(results: Column, hard: Column, icp: Column, evidence: Column, match_type: Column, n_evidence: Column, decision: Column, confidence: Column) -> Column:
    """struct(score, label): a company's quality from up to eight signals, weighed over those that apply.

    A hard FAIL is REJECT without a score; a PASS of 70 or more is STRONG;
    anything else is REVIEW. ``decision`` (null: not judged) and
    ``confidence`` are a verdict's.
    """
    none = F.lit(None).cast("double")

    def ruled(rule: str) -> Column:
        s = F.get(F.filter(results, lambda r: r["rule"] == rule), F.lit(0))["status"]
        return F.when(s == "PASS", 100.0).when(s == "HOLD", NEUTRAL).when(s == "FAIL", 0.0).otherwise(none)

    sure = F.coalesce(confidence.cast("double"), F.lit(NEUTRAL))
    verdict = F.when(decision == "GOOD_FIT", 60.0 + 0.4 * sure).when(decision == "WEAK_FIT", 30.0 + 0.3 * sure).when(decision == "HOLD", NEUTRAL).when(decision.isNotNull(), clamp(20.0 - 0.2 * sure))
    provenance = F.when(match_type == "structured", 90.0).when(match_type == "keyword_fallback", 45.0).otherwise(NEUTRAL)
    # The weights of the eight signals.
    weighed = [
        (0.40, clamp(icp)), (0.10, provenance), (0.20, clamp(evidence)), (0.10, ruled("employee_range")), (0.10, ruled("geography")), (0.05, ruled("company_type")),
        (0.15, F.when(decision.isNotNull(), clamp(verdict))), (0.10, F.when(n_evidence.isNotNull(), 100.0 * F.least(n_evidence, F.lit(10)) / 10)),
    ]
    zero = F.lit(0.0)
    total = sum((F.when(v.isNotNull(), w).otherwise(zero) for w, v in weighed), zero)
    score = sum((F.coalesce(w * v, zero) for w, v in weighed), zero) / total
    # Without the two scores that every judged company has, nothing is known: no score rather than one of what is left.
    score = F.when((F.coalesce(hard, F.lit("FAIL")) != "FAIL") & icp.isNotNull() & evidence.isNotNull(), clamp(score))
    label = F.when(hard == "FAIL", "REJECT").when((hard == "PASS") & (score >= STRONG), "STRONG").otherwise("REVIEW")
    return F.struct(score.alias("score"), label.alias("label"))
