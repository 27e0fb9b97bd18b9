"""Rounds of a batch: which sources may be asked, what is reopened, memberships, and the summary of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sources that search the web, and the prefix of mock sources.
WEB_SEARCH = ("tavily-company-discovery-v1", "serper-company-discovery-v1")
MOCK = "mock-"


def allowed_source(mode: Column, provider: Column) -> Column:
    """fast leaves web search out, safe uses nothing else; any other mode, or none, uses all sources."""
    web = F.coalesce(provider.isin(*WEB_SEARCH), F.lit(False))
    return F.coalesce(F.when(mode == "fast", ~web).when(mode == "safe", web), F.lit(True))


def mock_entities(entities: DataFrame, evidence: DataFrame, key: str = "entity_id") -> DataFrame:
    """Adds is_mock: true unless at least one of an entity's rows names a source that is no mock; without rows true."""
    real = evidence.groupBy(key).agg(F.coalesce(F.bool_or(~F.col("provider").startswith(MOCK)), F.lit(False)).alias("__real"))
    return entities.join(real, key, "left").select(*entities.columns, (~F.coalesce("__real", F.lit(False))).alias("is_mock"))


def reopened(items: DataFrame, companies: DataFrame) -> DataFrame:
    """New versions of the held items of the given (batch_id, company_id): open again at the stage where their company is known. Other outcomes stay closed."""
    held = items.where(F.col("outcome") == "HELD").join(companies.select("batch_id", "company_id").distinct(), ["batch_id", "company_id"], "left_semi")
    cleared = {c: F.lit(None).cast("string") for c in ("outcome", "qualification_decision", "hard_rule_result")}
    return held.withColumns(cleared | {"stage": F.lit("COMPANY_RESOLVED")}).select(*items.columns)


def new_memberships(found: DataFrame, stored: DataFrame) -> DataFrame:
    """(lead_id, icp_id, icp_version), each once, that are not stored yet."""
    keys = ["lead_id", "icp_id", "icp_version"]
    return found.select(*keys).distinct().join(stored.select(*keys).distinct(), keys, "left_anti")


def run_summary(leads: DataFrame, failed: DataFrame, run: str) -> DataFrame:
    """For each run of ``leads`` (outcome, hard_rule_result, human_review_decision, tier): counts by outcome, reviews pending and done, ranked leads, and the status.

    A lead that passes and has no review is pending. ``failed`` has the run
    and failed_count, the items that failed; a run without leads has a row if
    it is there. Leads that repeat in a run count once.
    """
    c = F.col
    n = lambda cond: F.count(F.when(cond, 1))
    one = leads.dropDuplicates([run, "lead_id"])
    made = one.groupBy(run).agg(
        F.count("*").alias("lead_count"), *[n(c("outcome") == o).alias(f"{o.lower()}_count") for o in ("ACCEPTED", "HELD", "REJECTED", "DUPLICATE")],
        n((c("hard_rule_result") == "PASS") & c("human_review_decision").isNull()).alias("review_pending_count"), n(c("human_review_decision").isNotNull()).alias("reviewed_count"), n(c("tier").isNotNull()).alias("ranked_count"),
    )
    both = made.join(failed.groupBy(run).agg(F.sum("failed_count").cast("long").alias("failed_count")), run, "full").na.fill(0)
    return both.withColumn("status", F.when(c("failed_count") > 0, "COMPLETED_WITH_ERRORS").otherwise("COMPLETED"))


# The stages that every item of a batch goes through, in order, and those of its leads.
BATCH_STAGES = (
    "DISCOVERY", "COMPANY_RESOLUTION", "ENRICHMENT", "PEOPLE_DISCOVERY_RESOLUTION", "EVIDENCE", "HARD_VALIDATION", "VERIFICATION", "BUSINESS_MODEL_SIGNALS", "SCORING", "LLM_QUALIFICATION", "ADVERSARIAL_REVIEW", "DEDUPLICATION",
)
LEAD_STAGES = ("HUMAN_REVIEW", "RANKING", "CONFIDENCE", "EXPORT")


def lead_statuses(leads: DataFrame, run: str) -> DataFrame:
    """Where each lead of a run stands: its outcome, hard rules, readiness, tier, and whether a review is there or awaited.

    ``leads`` has the run, lead_id, company_id, person_id, batch_outcome,
    hard_rule_result, readiness (a level), tier and human_review_decision. A
    lead that repeats in a run has one row.
    """
    c = F.col
    waits = F.coalesce((c("hard_rule_result") == "PASS") & c("human_review_decision").isNull(), F.lit(False))
    one = leads.dropDuplicates([run, "lead_id"])
    return one.select(run, "lead_id", "company_id", "person_id", "batch_outcome", "hard_rule_result", "readiness", c("tier").alias("ranking_tier"), "human_review_decision", waits.alias("human_review_pending"))


def stage_tallies(items: DataFrame, statuses: DataFrame, run: str) -> DataFrame:
    """(run, position, stage, attempted, succeeded, failed, pending): what became of each stage of a run.

    ``items`` are the batch's (run, outcome), which went through the stages of
    the batch or failed; ``statuses`` its :func:`lead_statuses`. One sum a
    side and run, spread into a row a stage; a run that only one side knows
    has all stages.
    """
    c, none = F.col, F.lit(0).cast("long")
    n = lambda cond: F.count(F.when(cond, 1))
    batch = items.groupBy(run).agg(F.count("*").alias("__items"), n(c("outcome") == "FAILED").alias("__failed"))
    known = statuses.groupBy(run).agg(F.count("*").alias("__leads"), n(c("human_review_decision").isNotNull()).alias("__reviewed"), n(c("human_review_pending")).alias("__waiting"), n(c("ranking_tier").isNotNull()).alias("__ranked"))
    both = batch.join(known, run, "full").na.fill(0)
    row = lambda k, stage, attempted, succeeded, failed, pending: F.struct(F.lit(k).alias("position"), F.lit(stage).alias("stage"), attempted.alias("attempted"), succeeded.alias("succeeded"), failed.alias("failed"), pending.alias("pending"))
    rows = [row(k, s, c("__items"), c("__items") - c("__failed"), c("__failed"), none) for k, s in enumerate(BATCH_STAGES)]
    one = F.lit(1).cast("long")
    of_leads = ((c("__leads"), c("__reviewed"), c("__waiting")), (c("__leads"), c("__ranked"), none), (c("__leads"), c("__leads"), none), (one, one, none))
    rows += [row(len(BATCH_STAGES) + k, s, attempted, done, none, waiting) for k, (s, (attempted, done, waiting)) in enumerate(zip(LEAD_STAGES, of_leads, strict=True))]
    return both.select(run, F.inline(F.array(*rows)))
