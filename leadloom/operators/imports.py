"""Sightings of resolved companies and people to evidence rows, and what their evidence text says of how they were found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import confidence_bucket, profile_id

# The fields of a company's sighting in the order in which they are stated, and the longest evidence text.
COMPANY_FIELDS = ("company_identity", "domain", "employee_count", "industry", "country", "company_type", "revenue_range", "employee_range", "linkedin_id", "description")
TEXT_CHARS = 2000

#: What a company's sighting may say beyond its identity; all columns may be null.
ATTRIBUTES = (
    "employee_count int, industry string, country string, revenue_range string, employee_range string, linkedin_id string, description string, "
    "industry_match_branch string, industry_match_terms array<string>, industry_match_term_origins array<string>, industry_match_scope string, industry_match_resolved_category_count int, "
    "industry_match_resolved_values array<string>, industry_match_branch_total_results int, keyword_match_terms array<string>, keyword_match_term_sources array<string>, keyword_match_term_origins array<string>, "
    "company_type_match_branch string, company_type_match_terms array<string>, company_type_match_resolved_category_count int"
)
#: How evidence text is read back.
PROVENANCE = (
    "industry_match struct<taxonomy_field: string, icp_terms: array<string>, icp_term_origins: array<string>, match_scope: string, resolved_category_count: int, resolved_values: array<string>, branch_total_results: int>, "
    "keyword_match struct<terms: array<string>, term_sources: array<string>, term_origins: array<string>>, company_type_match struct<taxonomy_field: string, icp_term: string>"
)


def _some(items: Column) -> Column:
    """An array, or null if it is empty."""
    return F.when(F.size(items) > 0, items)


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def industry_provenance(a: Column) -> Column:
    """JSON text of the branch and the keywords that found a sighting, of at most TEXT_CHARS characters; null if it tells neither."""
    branch = F.when(
        _text(a["industry_match_branch"]).isNotNull() & (F.size(a["industry_match_terms"]) > 0),
        F.struct(
            a["industry_match_branch"].alias("taxonomy_field"), a["industry_match_terms"].alias("icp_terms"), _some(a["industry_match_term_origins"]).alias("icp_term_origins"), _text(a["industry_match_scope"]).alias("match_scope"),
            a["industry_match_resolved_category_count"].alias("resolved_category_count"), a["industry_match_resolved_values"].alias("resolved_values"), a["industry_match_branch_total_results"].alias("branch_total_results"),
        ),
    )
    words = F.when(F.size(a["keyword_match_terms"]) > 0, F.struct(a["keyword_match_terms"].alias("terms"), _some(a["keyword_match_term_sources"]).alias("term_sources"), _some(a["keyword_match_term_origins"]).alias("term_origins")))
    made = F.to_json(F.struct(branch.alias("industry_match"), words.alias("keyword_match")))
    return F.when(branch.isNotNull() | words.isNotNull(), F.substring(made, 1, TEXT_CHARS))


def company_type_match(a: Column) -> Column:
    """struct(taxonomy_field, icp_term) if exactly one term was resolved to exactly one category."""
    term = F.get(a["company_type_match_terms"], F.lit(0))
    one = _text(a["company_type_match_branch"]).isNotNull() & (F.size(a["company_type_match_terms"]) == 1) & (a["company_type_match_resolved_category_count"] == 1) & (F.trim(term) != "")
    return F.when(one, F.struct(a["company_type_match_branch"].alias("taxonomy_field"), term.alias("icp_term")))


def _rows(sightings: DataFrame, kind: str, stated: list[tuple[str, Column, Column | None]]) -> DataFrame:
    """One evidence row for each stated field; what is not stated has none."""
    none = F.lit(None).cast("string")
    items = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value_json"), (t if t is not None else none).alias("evidence_text")) for f, v, t in stated])
    return sightings.select(
        F.lit(kind).alias("entity_type"), "entity_id", F.inline(F.filter(items, lambda i: i["value_json"].isNotNull())), F.col("provider_id").alias("provider"), "external_id", F.col("discovered_at").alias("retrieved_at"),
        F.lit("UNKNOWN").alias("confidence"),
    )


def _json(c: Column) -> Column:
    """A string as JSON text; null and empty: null."""
    return F.when(c != "", F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))


def company_evidence(candidates: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Evidence rows of candidates that were resolved to a company.

    ``candidates`` has candidate_id, provider_id, external_id, name, domain,
    discovered_at and attributes (a struct of ATTRIBUTES); ``resolutions``
    candidate_id and company_id (null: unresolved, no rows). An empty text
    states nothing; a name is stated whatever it is.
    """
    c, a = F.col, F.col("attributes")
    known = resolutions.where("company_id is not null").select("candidate_id", c("company_id").alias("entity_id"))
    rows = candidates.join(known, "candidate_id")
    kind = company_type_match(a)
    stated = [
        ("company_identity", F.coalesce(_json(c("name")), F.when(c("name") == "", F.lit('""'))), None), ("domain", _json(c("domain")), None), ("employee_count", a["employee_count"].cast("string"), None),
        ("industry", _json(a["industry"]), industry_provenance(a)), ("country", _json(a["country"]), None), ("company_type", _json(kind["icp_term"]), F.to_json(F.struct(kind.alias("company_type_match")))),
        *[(f, _json(a[f]), None) for f in ("revenue_range", "employee_range", "linkedin_id", "description")],
    ]
    return _rows(rows, "COMPANY", stated)


def person_evidence(candidates: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Evidence rows of people: name, title, company and profile; attributes is a map with linkedin_id or linkedin_url."""
    c = F.col
    known = resolutions.where("person_id is not null").select("candidate_id", c("person_id").alias("entity_id"))
    stated = [
        ("person_identity", F.coalesce(_json(c("name")), F.when(c("name") == "", F.lit('""'))), None), ("current_title", _json(c("title")), None), ("company_association", _json(c("company_id").cast("string")), None),
        ("linkedin_id", _json(profile_id(c("attributes"))), None),
    ]
    return _rows(candidates.join(known, "candidate_id"), "PERSON", stated)


def fact_evidence(facts: DataFrame) -> DataFrame:
    """Enrichment facts (company_id, field, value_json, provider_id, external_id, retrieved_at, confidence as a number) as evidence rows."""
    c = F.col
    return facts.select(
        F.lit("COMPANY").alias("entity_type"), c("company_id").alias("entity_id"), "field", "value_json", F.lit(None).cast("string").alias("evidence_text"), c("provider_id").alias("provider"), "external_id", "retrieved_at",
        confidence_bucket(c("confidence")).alias("confidence"),
    )


def read_provenance(evidence_text: Column) -> Column:
    """The struct of PROVENANCE that an evidence text holds; null if it is no JSON object."""
    return F.when(F.substring(F.ltrim(evidence_text), 1, 1) == "{", F.from_json(evidence_text, PROVENANCE))


def discovery_matches(evidence: DataFrame) -> DataFrame:
    """One row a company with evidence: match_type, keyword_terms, keyword_sources, scope, total_results.

    ``structured`` if any industry row tells a branch, ``keyword_fallback``
    with industry rows alone, else ``unknown``. Each of the others is that of
    the first industry row, by time and id, that tells it. One partial sum a
    task; no company's rows are gathered.
    """
    p, is_industry = read_provenance(F.col("evidence_text")), F.col("field") == "industry"
    rows = evidence.where(F.col("entity_type") == "COMPANY").select(F.col("entity_id").alias("company_id"), is_industry.alias("is_industry"), F.when(is_industry, p).alias("p"), "retrieved_at", "id")
    told = lambda c: F.min(F.when(c.isNotNull(), F.struct("retrieved_at", "id", c.alias("v"))))["v"]
    branch, empty = F.col("p.industry_match"), F.array().cast("array<string>")
    kind = F.when(F.bool_or(F.coalesce(branch.isNotNull(), F.lit(False))), "structured").when(F.bool_or("is_industry"), "keyword_fallback").otherwise("unknown")
    return rows.groupBy("company_id").agg(
        kind.alias("match_type"), F.coalesce(told(F.col("p.keyword_match.terms")), empty).alias("keyword_terms"), F.coalesce(told(F.col("p.keyword_match.term_sources")), empty).alias("keyword_sources"),
        F.coalesce(told(branch["match_scope"]), F.lit("unknown")).alias("scope"), told(branch["branch_total_results"]).alias("total_results"),
    )
