"""Hard rules: every candidate against a customer profile, as PASS, FAIL or HOLD with reasons.

Profiles are few (each is a row that a person wrote); their terms are brought
to comparable form once, before the join, and Spark broadcasts them while they
are under its own size limit. Candidates are not shuffled then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, country_code, employee_bucket, title_key

# Rules in the order in which they are judged; custom rules follow them.
RULES = ("employee_range", "geography", "industry", "allowed_titles", "company_type", "exclusions")


def text_key(c: Column) -> Column:
    return F.lower(clean_text(c))


def _result(rule: str, status: Column, reason: Column) -> Column:
    """struct(rule, status, reason); only FAIL and HOLD have a reason."""
    return F.struct(F.lit(rule).alias("rule"), status.alias("status"), F.when(status.isin("FAIL", "HOLD"), reason).alias("reason"))


def employee_rule(count: Column, bucket: Column, low: Column, high: Column) -> Column:
    """An exact count decides; else a bucket that overlaps the range passes; unknown holds."""
    b = employee_bucket(bucket)
    small, large = F.coalesce(count < low, F.lit(False)), F.coalesce(count > high, F.lit(False))
    below, above = F.coalesce(b["high"] < F.coalesce(low, F.lit(0)), F.lit(False)), F.coalesce(b["low"] > high, F.lit(False))
    by_count = F.when(small | large, "FAIL").otherwise("PASS")
    by_bucket = F.when(below | above, "FAIL").otherwise("PASS")
    status = F.when(low.isNull() & high.isNull(), "NOT_APPLICABLE").when(count.isNotNull(), by_count).when(b.isNotNull(), by_bucket).otherwise("HOLD")
    reason = (
        F.when(count.isNotNull(), F.when(small, "EMPLOYEE_TOO_SMALL").otherwise("EMPLOYEE_TOO_LARGE"))
        .when(b.isNotNull(), F.when(below, "EMPLOYEE_TOO_SMALL").otherwise("EMPLOYEE_TOO_LARGE")).otherwise("EMPLOYEE_COUNT_UNKNOWN")
    )
    return _result("employee_range", status, reason)


def geography_rule(place: Column, codes: Column, other_keys: Column) -> Column:
    """A known code in the list, or the text among unrecognised terms, passes; a known code fails only if no such terms are left open."""
    code = country_code(place)
    allowed = F.coalesce(F.array_contains(codes, code), F.lit(False)) | F.coalesce(F.array_contains(other_keys, text_key(place)), F.lit(False))
    status = (
        F.when((F.size(codes) == 0) & (F.size(other_keys) == 0), "NOT_APPLICABLE").when(place.isNull(), "HOLD").when(allowed, "PASS")
        .when(code.isNotNull() & (F.size(other_keys) == 0), "FAIL").otherwise("HOLD")
    )
    return _result("geography", status, F.when(place.isNull(), "GEOGRAPHY_UNKNOWN").when(status == "FAIL", "WRONG_GEOGRAPHY").otherwise("GEOGRAPHY_UNRESOLVED"))


def choice_rule(rule: str, value_key: Column, allowed_keys: Column, unknown: str, mismatch: str) -> Column:
    """Equality with an allowed value; both sides are keys already."""
    hit = F.array_contains(allowed_keys, value_key)
    status = F.when(F.size(allowed_keys) == 0, "NOT_APPLICABLE").when(value_key.isNull(), "HOLD").when(hit, "PASS").otherwise("FAIL")
    return _result(rule, status, F.when(value_key.isNull(), unknown).otherwise(mismatch))


def exclusion_rule(values: list[Column], excluded_keys: Column) -> Column:
    """Fails if an exclusion equals a known attribute or one of the two contains the other; blanks match nothing; all unknown holds."""
    known = F.array_compact(F.array(*[text_key(v) for v in values]))
    met = F.exists(known, lambda v: F.exists(excluded_keys, lambda e: (v != "") & (e != "") & (F.contains(v, e) | F.contains(e, v))))
    status = F.when(F.size(excluded_keys) == 0, "NOT_APPLICABLE").when(F.size(known) == 0, "HOLD").when(met, "FAIL").otherwise("PASS")
    return _result("exclusions", status, F.when(status == "FAIL", "EXPLICIT_EXCLUSION").otherwise("INSUFFICIENT_EVIDENCE"))


def custom_results(labels: Column, answers: Column) -> Column:
    """One result a label from a map of booleans; a missing one holds."""

    def one(label: Column) -> Column:
        a = answers[label]
        status = F.when(a.isNull(), "HOLD").when(a, "PASS").otherwise("FAIL")
        return F.struct(F.concat(F.lit("custom_rule:"), label).alias("rule"), status.alias("status"), F.when(a.isNull(), "CUSTOM_RULE_UNRESOLVED").when(~a, "CUSTOM_RULE_FAILED").alias("reason"))

    return F.transform(labels, one)


def overall(results: Column) -> Column:
    has = lambda s: F.exists(results, lambda r: r["status"] == s)
    return F.when(has("FAIL"), "FAIL").when(has("HOLD"), "HOLD").otherwise("PASS")


def reason_codes(results: Column) -> Column:
    """Codes of failed rules first, then of unresolved ones, each in rule order."""
    coded = lambda s: F.transform(F.filter(results, lambda r: r["status"] == s), lambda r: r["reason"])
    return F.concat(coded("FAIL"), coded("HOLD"))


def profile_keys(icps: DataFrame) -> DataFrame:
    """Profiles with the comparable form of every term: one row each, computed once."""
    c, empty = F.col, F.array().cast("array<string>")
    keys = lambda name, key: F.transform(F.coalesce(c(name), empty), key)
    labels = c("custom_rules") if "custom_rules" in icps.columns else empty
    return icps.select(
        "icp_id", "min_employees", "max_employees", keys("industries", text_key).alias("industry_keys"), F.coalesce("country_codes", empty).alias("country_codes"),
        keys("other_places", text_key).alias("place_keys"), keys("titles", title_key).alias("title_keys"), keys("company_types", text_key).alias("type_keys"),
        keys("excluded", text_key).alias("excluded_keys"), F.coalesce(labels, empty).alias("custom_labels"),
    )


KEYS = ("min_employees", "max_employees", "industry_keys", "country_codes", "place_keys", "title_keys", "type_keys", "excluded_keys", "custom_labels")


def judged(rows: DataFrame) -> DataFrame:
    """Adds results, overall and reasons to candidates joined with :func:`profile_keys`."""
    c = F.col
    attributes = [c(x).cast("string") for x in ("company_name", "domain", "industry", "country", "company_type", "title")]
    answers = c("custom_answers") if "custom_answers" in rows.columns else F.create_map().cast("map<string,boolean>")
    results = F.concat(
        F.array(
            employee_rule(c("employee_count"), c("employee_range"), c("min_employees"), c("max_employees")), geography_rule(c("country"), c("country_codes"), c("place_keys")),
            choice_rule("industry", text_key(c("industry")), c("industry_keys"), "INDUSTRY_UNKNOWN", "INDUSTRY_MISMATCH"),
            choice_rule("allowed_titles", title_key(c("title")), c("title_keys"), "TITLE_UNKNOWN", "TITLE_NOT_ALLOWED"),
            choice_rule("company_type", text_key(c("company_type")), c("type_keys"), "COMPANY_TYPE_UNKNOWN", "COMPANY_TYPE_EXCLUDED"),
            exclusion_rule(attributes, c("excluded_keys")),
        ),
        custom_results(c("custom_labels"), F.coalesce(answers, F.create_map().cast("map<string,boolean>"))),
    )
    rows = rows.withColumn("results", results)
    return rows.withColumns({"overall": overall(c("results")), "reasons": reason_codes(c("results"))})


def evaluate(candidates: DataFrame, icps: DataFrame) -> DataFrame:
    """Each candidate against the profile it names (icp_id): its columns, results, overall and reasons.

    Candidates whose profile is unknown or null have no result row. Null
    lists of a profile are empty; custom_answers, a map of booleans by label,
    may be missing.
    """
    done = judged(candidates.join(profile_keys(icps), "icp_id"))
    return done.select(*candidates.columns, "results", "overall", "reasons")
