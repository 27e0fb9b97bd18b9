"""What reviewers' feedback says about signals, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decisions, prefixes of signals by kind, the size of a nudge by sample, and the least distance of a rate from one half.
DECISIONS = ("GOOD_FIT", "WEAK_FIT", "NOT_FIT", "HOLD")
MODEL, SIGNAL, HARD = "business_model:", "commercial_signal:", "hard_rule_result:"
NUDGES = {"LOW": 0.2, "MODERATE": 0.5, "HIGH": 1.0}
LEAST_DISTANCE = 0.15


def sample_label(n: Column, least: int = 5) -> Column:
    """How far a number of observations can be relied on; ``least`` are the fewest that count."""
    return F.when(n < least, "INSUFFICIENT_DATA").when(n < 2 * least, "LOW").when(n < 4 * least, "MODERATE").otherwise("HIGH")


def decision_counts(feedback: DataFrame, icp: str = "icp_id") -> DataFrame:
    """Counts by decision for each profile and, with is_global, over all, in one pass."""
    counts = [F.count(F.when(F.col("decision") == d, 1)).alias(f"n_{d.lower()}") for d in DECISIONS]
    return feedback.rollup(icp).agg(F.grouping(icp).cast("int").alias("is_global"), *counts)


def signal_correlation(feedback: DataFrame, least: int = 5) -> DataFrame:
    """For each signal: positive, negative and all observations, and the share of positive among the decided ones (null without any)."""
    one = feedback.select("decision", F.explode("signals").alias("signal"))
    made = one.groupBy("signal").agg(
        F.count(F.when(F.col("decision") == "GOOD_FIT", 1)).alias("positive"), F.count(F.when(F.col("decision") == "NOT_FIT", 1)).alias("negative"), F.count("*").alias("total")
    )
    return made.withColumn("rate", F.try_divide("positive", F.col("positive") + F.col("negative"))).withColumn("sample", sample_label(F.col("total"), least))


def reason_frequency(feedback: DataFrame, least: int = 5) -> DataFrame:
    """For each reason code: counts by decision, total and sample label."""
    one = feedback.select("decision", F.explode("reason_codes").alias("reason_code"))
    counts = [F.count(F.when(F.col("decision") == d, 1)).alias(f"n_{d.lower()}") for d in DECISIONS]
    made = one.groupBy("reason_code").agg(*counts, F.count("*").alias("total"))
    return made.withColumn("sample", sample_label(F.col("total"), least))


def analysis(feedback: DataFrame, icp: str = "icp_id", least: int = 5) -> DataFrame:
    """For each profile and, with is_global, over all: counts by decision, total, whether that is too few (cold start), and the sample label."""
    made = decision_counts(feedback, icp)
    total = sum((F.col(f"n_{d.lower()}") for d in DECISIONS[1:]), F.col(f"n_{DECISIONS[0].lower()}"))
    return made.withColumn("total", total).withColumn("is_cold_start", F.col("total") < least).withColumn("sample", sample_label(F.col("total"), least))


def observations(feedback: DataFrame, leads: DataFrame, hard: DataFrame, models: DataFrame, signals: DataFrame) -> DataFrame:
    """Feedback (lead_ref, icp_id, decision, reason_codes) with the set ``signals`` of what is known of its lead, as namespace:value.

    ``leads`` has lead_id and company_id; ``hard`` the latest result by
    (icp_id, company_id), ``models`` those of :mod:`signals`, ``signals`` status
    by (company_id, signal), of which only SUPPORTED ones count. Feedback on
    an unknown lead keeps an empty set. Signals are gathered by company (a
    bounded vocabulary), never by feedback.
    """
    c, none = F.col, F.array().cast("array<string>")
    named = lambda prefix, col: F.concat(F.lit(prefix), c(col))
    supported = signals.where(c("status") == "SUPPORTED").groupBy("company_id").agg(F.collect_set(named(SIGNAL, "signal")).alias("__signals"))
    classified = models.where(c("status") == "CLASSIFIED")
    model = classified.select("company_id", F.transform(F.array_union(F.array("primary"), "models"), lambda m: F.concat(F.lit(MODEL), m)).alias("__models"))
    result = hard.select("icp_id", "company_id", named(HARD, "overall").alias("__hard"))
    rows = feedback.join(leads.select(c("lead_id").alias("lead_ref"), "company_id"), "lead_ref", "left")
    rows = rows.join(supported, "company_id", "left").join(model, "company_id", "left").join(result, ["icp_id", "company_id"], "left")
    found = F.array_sort(F.array_union(F.coalesce("__signals", none), F.array_union(F.coalesce("__models", none), F.array_compact(F.array("__hard")))))
    return rows.select(*feedback.columns, found.alias("signals"))


def provider_signals(signals: DataFrame) -> DataFrame:
    """(provider, signals): the names of signals that a provider's rows ever supported; ``signals`` has signal and providers (array)."""
    one = signals.select(F.concat(F.lit(SIGNAL), "signal").alias("signal"), F.explode("providers").alias("provider"))
    return one.groupBy("provider").agg(F.array_sort(F.collect_set("signal")).alias("signals"))


def _nudged(correlation: DataFrame, is_cold_start: bool, up: str, down: str) -> DataFrame:
    """Signals with enough observations and a decided rate; none at all in a cold start."""
    size = F.element_at(F.create_map(*[x for k, v in NUDGES.items() for x in (F.lit(k), F.lit(v))]), F.col("sample"))
    far = F.col("rate") - 0.5
    rows = correlation.where(F.lit(not is_cold_start) & F.col("sample").isin(*NUDGES) & (F.abs(far) >= LEAST_DISTANCE))
    return rows.select("signal", "total", "sample", F.when(far > 0, up).otherwise(down).alias("effect"), F.when(far > 0, size).otherwise(-size).alias("magnitude"))


def recommendations(correlation: DataFrame, is_cold_start: bool = False) -> DataFrame:
    """Nudges for signals: recommendation_type, signal, total, sample, effect, magnitude.

    A signal needs enough observations and a rate at least LEAST_DISTANCE from
    one half; the outcome of hard rules is never recommended.
    """
    soft = F.col("signal").startswith(MODEL) | F.col("signal").startswith(SIGNAL)
    kind = F.when(soft, "SOFT_PREFERENCE_WEIGHT_HINT").otherwise("RANKING_TIE_BREAK_NUDGE")
    rows = _nudged(correlation.where(~F.col("signal").startswith(HARD)), is_cold_start, "INCREASE_PRIORITY", "DECREASE_PRIORITY")
    return rows.select(kind.alias("recommendation_type"), "*")


def provider_hints(correlation: DataFrame, is_cold_start: bool = False) -> DataFrame:
    """The same for providers that supply a commercial signal."""
    rows = _nudged(correlation.where(F.col("signal").startswith(SIGNAL)), is_cold_start, "INCREASE_PROVIDER_USAGE", "DECREASE_PROVIDER_USAGE")
    return rows.select(F.lit("PROVIDER_PRIORITY_HINT").alias("recommendation_type"), "*")
