"""Stored tables and vendor answers, read with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of a lead store.
SCHEMAS = {
    "icps": "id string, name string, version int, hard_rules string, soft_preferences string, filters string",
    "discovery_candidates": "id string, run_id string, icp_id string, icp_version int, provider_id string, external_id string, name string, domain string, attributes string, discovered_at timestamp",
    "canonical_companies": "id string, canonical_name string, canonical_domain string, aliases array<string>, provider_identities map<string,string>",
    "company_resolutions": "id string, candidate_id string, status string, canonical_company_id string, matched_company_id string, confidence string, matched_signals array<string>, conflicting_signals array<string>, reason_code string",
    "canonical_people": "id string, canonical_name string, canonical_company_id string, associated_company_ids array<string>, aliases array<string>, linkedin_id string, provider_identities map<string,string>",
    "evidence": "id string, entity_type string, entity_id string, field string, value_json string, source_provider_id string, source_type string, source_url string, external_id string, retrieved_at timestamp, evidence_text string, confidence string",
    "hard_icp_validations": "id string, icp_id string, company_id string, person_id string, overall_result string, rule_results array<struct<rule: string, status: string, reason_code: string>>, reason_codes array<string>, validated_at timestamp",
    "lead_scores": "id string, icp_id string, company_id string, person_id string, icp_score double, commercial_score double, evidence_score double, freshness_score double, identity_confidence double, final_score double, scored_at timestamp",
    "canonical_leads": "id string, company_id string, person_id string",
    "lead_icp_memberships": "lead_id string, icp_id string, icp_version int",
    "human_reviews": "id string, lead_id string, icp_id string, requested_decision string, effective_decision string, reason_codes array<string>, created_at timestamp",
    "feedback": "id string, lead_ref string, icp_id string, decision string, reason_codes array<string>, created_at timestamp",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table; columns that a file lacks are null."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def vendor_records(answers: DataFrame, body: str, mapping: dict[str, str], id_path: str, name_path: str) -> DataFrame:
    """Vendor rows in the common form: the columns of ``answers`` without ``body``, external_id, name, attributes (map).

    ``mapping`` leads from attribute to the JSON path of its value in the text
    ``body``. What is absent or null stays absent; rows without an id or a name
    are dropped.
    """
    at = lambda path: F.nullif(F.get_json_object(body, path), F.lit(""))
    pairs = F.map_filter(F.create_map(*[x for a, p in mapping.items() for x in (F.lit(a), at(p))]), lambda k, v: v.isNotNull())
    rest = [c for c in answers.columns if c != body]
    return answers.select(*rest, at(id_path).alias("external_id"), at(name_path).alias("name"), pairs.alias("attributes")).where("external_id is not null and name is not null")


def branch_tags(kind: str, branch: Column, terms: Column, resolved: Column, sources: Column | None = None, origins: Column | None = None, total: Column | None = None) -> dict[str, Column]:
    """Columns that tell how a search branch found a row; ``kind`` is industry_match, keyword_match or company_type_match.

    ``resolved`` are the categories that the branch's terms stand for: one is
    a single_category scope, several a multi_category one.
    """
    none, n = F.lit(None).cast("array<string>"), F.size(resolved)
    if kind == "keyword_match":
        return {"keyword_match_terms": terms, "keyword_match_term_sources": none if sources is None else sources, "keyword_match_term_origins": none if origins is None else origins}
    tags = {f"{kind}_branch": branch, f"{kind}_terms": terms, f"{kind}_term_origins": none if origins is None else origins, f"{kind}_resolved_category_count": n}
    if kind == "industry_match":
        tags |= {
            "industry_match_scope": F.when(n == 1, "single_category").when(n > 1, "multi_category"), "industry_match_resolved_values": resolved,
            "industry_match_branch_total_results": F.lit(None).cast("int") if total is None else total,
        }
    return tags
