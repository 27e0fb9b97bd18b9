"""Lead exports and append-only snapshots. A folder's files, in order of their names, continue each other."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import shuffles_freed
from ..functions.text import split_person_name

# The columns of the full export, of the two import layouts, and of the review table with their headers.
COLUMNS = (
    "schema_version", "icp_id", "icp_version", "batch_id", "lead_id", "company_id", "company_name", "company_domain", "person_id", "person_name", "person_title", "person_linkedin_id", "hard_rule_result",
    "hard_rule_reason_codes", "final_score", "icp_score", "commercial_score", "evidence_score", "freshness_score", "identity_confidence", "qualification_decision", "qualification_confidence", "qualification_summary",
    "adversarial_result", "adversarial_confidence", "verification_status", "human_review_decision", "human_review_reason_codes", "rank", "tier", "ranking_reason_codes", "is_duplicate_occurrence",
    "evidence_conflicting_fields", "evidence_missing_critical_fields", "evidence_ids", "hard_validation_id", "score_id", "qualification_id", "adversarial_review_id", "verification_ids", "human_review_id",
    "deduplication_ids", "company_resolution_id", "person_resolution_id", "source_provider_ids", "exported_at",
)
SHARED = {
    "LinkedIn URL": "person_linkedin_id", "Qualification Summary": "qualification_summary", "Final Score": "final_score", "Rank": "rank", "Tier": "tier",
}
FULL_NAME = "Full Name (unsplit, authoritative)"
LAYOUTS = {
    "hubspot": {"Job Title": "person_title", "Company name": "company_name", "Company domain name": "company_domain"},
    "salesforce": {"Title": "person_title", "Account Name": "company_name", "Website": "company_domain"},
}
REVIEW = {
    "Company": "company_name", "Company Domain": "company_domain", "Company LinkedIn": "company_linkedin_url", "Person": "person_name", "Title": "title", "Email": "email", "Email Status": "email_status", "Phone": "phone",
    "Person LinkedIn": "person_linkedin_url", "Tier": "tier", "Final Score": "final_score", "Qualification": "qualification_decision", "Enrichment Status": "enrichment_status",
}


def _shown(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "boolean":
        c = F.when(c, "TRUE").otherwise(F.when(c.isNotNull(), "FALSE"))
    elif kind.startswith("array"):
        c = F.array_join(c, ";")
    elif kind == "timestamp":
        c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx")
    return F.coalesce(c.cast("string"), F.lit("UNKNOWN"))


def export_values(leads: DataFrame) -> DataFrame:
    """All columns as export text: null UNKNOWN, booleans TRUE or FALSE, lists joined by semicolons, an empty list an empty text."""
    return leads.select(*[_shown(n, k).alias(n) for n, k in leads.dtypes])


def crm_rows(leads: DataFrame, layout: str, prefix: str = "") -> DataFrame:
    """Leads as rows that a CRM imports: the split name and the name as it is, twelve columns in all.

    ``prefix`` goes before the headers that no CRM has of its own, such as ``Rank``.
    """
    kinds, name = dict(leads.dtypes), split_person_name(F.col("person_name"))
    part = lambda p: F.coalesce(F.nullif(name[p], F.lit("")), F.lit("UNKNOWN"))
    own = LAYOUTS[layout] | {prefix + h: c for h, c in SHARED.items()}
    email = F.coalesce(F.col("verified")["person.email"], F.lit("UNKNOWN"))
    return leads.select(email.alias("Email"), part("first").alias("First Name"), part("last").alias("Last Name"), _shown("person_name", "string").alias(prefix + FULL_NAME), *[_shown(c, kinds[c]).alias(h) for h, c in own.items()])


def review_rows(leads: DataFrame) -> DataFrame:
    """The review table: thirteen columns as text, null empty."""
    return leads.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(h) for h, c in REVIEW.items()])


def _csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("lineSep", "\n").option("escape", '"').option("emptyValue", "").csv(path)


def write_csv(leads: DataFrame, path: str, order: list[str] = ["icp_id", "rank"], columns: tuple[str, ...] = COLUMNS) -> None:  # noqa: B006
    """The full export as CSV with a header, in order of rank."""
    _csv(export_values(leads.orderBy(*order).select(*columns)), path)


def write_crm_csv(leads: DataFrame, path: str, layout: str, prefix: str = "") -> None:
    """``layout``: hubspot or salesforce."""
    _csv(crm_rows(leads.orderBy("icp_id", "rank"), layout, prefix), path)


def write_review_csv(leads: DataFrame, path: str) -> None:
    _csv(review_rows(leads.orderBy("rank", "lead_id")), path)


def nested(leads: DataFrame) -> DataFrame:
    """One struct a lead, as the JSON export nests it."""
    of = lambda *names: F.struct(*names)
    return leads.select(
        "schema_version", "icp_id", "icp_version", "batch_id", "lead_id",
        of("company_id", "company_name", "company_domain", "person_id", "person_name", "person_title", "person_linkedin_id").alias("identity"),
        of(F.col("verified").alias("verified_fields"), F.col("evidence_conflicting_fields").alias("conflicting_fields"), F.col("evidence_missing_critical_fields").alias("missing_critical_fields"), "evidence_ids").alias("evidence"),
        "hard_rule_result", "hard_rule_reason_codes", of("final_score", "icp_score", "commercial_score", "evidence_score", "freshness_score", "identity_confidence").alias("scores"),
        "qualification_decision", "qualification_confidence", "qualification_summary", "adversarial_result", "adversarial_confidence", "verification_status", "human_review_decision", "human_review_reason_codes",
        "rank", "tier", "ranking_reason_codes", "is_duplicate_occurrence",
        of("hard_validation_id", "score_id", "qualification_id", "adversarial_review_id", "verification_ids", "human_review_id", "deduplication_ids", "company_resolution_id", "person_resolution_id", "source_provider_ids").alias("provenance"),
        "exported_at",
    )


def write_json(leads: DataFrame, path: str, compression: str = "none") -> None:
    """The nested export, a lead a line in order of rank, under ``leads``; under ``metadata`` one line a profile with its number of leads."""
    keep = {"ignoreNullFields": "false", "compression": compression}
    with shuffles_freed(leads.sparkSession):
        nested(leads.orderBy("icp_id", "rank")).write.options(**keep).json(f"{path}/leads")
    heads = leads.groupBy("icp_id").agg(F.max("schema_version").alias("schema_version"), F.max("icp_version").alias("icp_version"), F.max("batch_id").alias("batch_id"), F.count("*").alias("lead_count"), F.max("exported_at").alias("generated_at"))
    heads.orderBy("icp_id").write.options(**keep).json(f"{path}/metadata")


COMMIT_FOLDER = "commits"
COMMIT = "snapshot_date string, icp_id string, take string, n_rows long"


def _under(spark: SparkSession, path: str, name: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot_date, icp_id, take, n_rows) of every committed snapshot; of one profile and day the first that was committed."""
    if not _under(spark, path, COMMIT_FOLDER):
        return spark.createDataFrame([], COMMIT)
    made = spark.read.schema(COMMIT).parquet(f"{path}/{COMMIT_FOLDER}")
    return made.groupBy("snapshot_date", "icp_id").agg(F.min(F.struct("take", "n_rows")).alias("x")).select("snapshot_date", "icp_id", "x.*")


def _profile(icp: str) -> Column:
    """A profile's folder; never read as a number."""
    return F.coalesce(F.concat(F.lit("p:"), F.col(icp).cast("string")), F.lit("-"))


def append_snapshot(rows: DataFrame, path: str, date: str) -> None:
    """Add a dated copy by profile (icp_id); what is there is never changed.

    Rows go to a folder of their own, which counts only once its commit, one
    small file, is written after it. So a run that dies leaves nothing that is
    read, and its repetition completes the day; a profile that already has a
    snapshot of that day keeps it, and repeating a day changes nothing.
    """
    spark = rows.sparkSession
    there = [r.icp_id for r in snapshots(spark, path).where(F.col("snapshot_date") == date).select("icp_id").collect()]  # profiles of one day: few
    take = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    fresh = rows.where(~F.coalesce(F.col("icp_id").cast("string").isin(there), F.lit(False)))
    fresh.withColumn("profile", _profile("icp_id")).write.partitionBy("profile").parquet(f"{path}/rows/take={take}")
    back = spark.read.schema(rows.schema).parquet(f"{path}/rows/take={take}")
    made = back.groupBy(F.col("icp_id").cast("string").alias("icp_id")).agg(F.count("*").alias("n_rows"))
    made = made.select(F.lit(date).alias("snapshot_date"), "icp_id", F.lit(take).alias("take"), "n_rows")
    made.coalesce(1).write.mode("append").parquet(f"{path}/{COMMIT_FOLDER}")


def read_snapshot(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """The rows of each profile's latest snapshot of ``as_of`` or before, with its snapshot_date; profiles without one have no rows.

    Only folders that a commit names are opened, and in them only the
    profiles that are asked for.
    """
    chosen = snapshots(spark, path).where(F.col("snapshot_date") <= as_of).groupBy("icp_id").agg(F.max(F.struct("snapshot_date", "take")).alias("x")).select("icp_id", "x.*")
    takes = [r.take for r in chosen.select("take").distinct().collect()]  # at most one a profile
    if not takes:
        raise ValueError(f"no snapshot of {as_of} or before")
    held = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/take={t}" for t in takes])
    named = chosen.select(_profile("icp_id").alias("__profile"), F.col("take").alias("__take"), "snapshot_date")
    return held.join(named, (F.col("profile") == F.col("__profile")) & (F.col("take") == F.col("__take"))).drop("profile", "take", "__profile", "__take")
