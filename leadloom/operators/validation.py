"""Companies and people against profiles, by what their evidence supports.

Only SUPPORTED and SUPPORTED_STRUCTURED fields reach a candidate; all others
are unknown, and unknown holds. Every step is an aggregate by entity, or an
equi-join of such aggregates; profiles are few rows. Only pairs that are asked
for are judged, never every company with every profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text
from .evidence import ELIGIBLE, value_string
from .imports import read_provenance
from .rules import judged, profile_keys, text_key

COMPANY = {"company_identity": "company_name", "domain": "domain", "industry": "industry", "country": "country", "employee_count": "employee_count", "employee_range": "employee_range", "company_type": "company_type"}


def _none() -> Column:
    return F.array().cast("array<string>")


def _terms(c: str) -> Column:
    return F.array_distinct(F.transform(F.coalesce(c, _none()), text_key))


def eligible_fields(status: DataFrame, names: dict[str, str] = COMPANY) -> DataFrame:
    """One row an entity: its eligible fields as columns of text; ``status`` is that of ``evidence.field_status`` with JSON values."""
    good = status.where(F.col("status").isin(*ELIGIBLE) & F.col("field").isin(*names))
    text = F.when(F.col("value") != "null", F.coalesce(value_string(F.col("value")), F.col("value")))
    # A JSON string is never a head count, a number never a range.
    wrong = ((F.col("field") == "employee_count") & ~F.col("value").rlike(r"^-?\d+$")) | ((F.col("field") == "employee_range") & value_string(F.col("value")).isNull())
    return good.where(~F.coalesce(wrong, F.lit(False))).groupBy("entity_id").agg(*[F.max(F.when(F.col("field") == f, text)).alias(name) for f, name in names.items()])


def covering_sightings(evidence: DataFrame, asked: DataFrame, icps: DataFrame) -> DataFrame:
    """(icp_id, company_id, value, term, evidence_id, need): sightings of an industry that cover a term of the company's profile.

    A sighting covers a term of the profile if it is its only keyword that
    comes from the industry list (all keywords, where sources do not match
    them one by one). Needed are the industries less the combination terms;
    a profile of fewer than two industries asks for no corroboration.
    """
    c = F.col
    need = icps.where(F.size("industries") >= 2).select("icp_id", _terms("industries").alias("own"), F.array_except(_terms("industries"), _terms("combinations")).alias("need"))
    p = read_provenance(c("evidence_text"))["keyword_match"]
    sourced = F.when(F.size(p["term_sources"]) == F.size(p["terms"]), F.transform(F.filter(F.arrays_zip(p["terms"].alias("t"), p["term_sources"].alias("s")), lambda z: z["s"] == "industry"), lambda z: z["t"])).otherwise(p["terms"])
    one = evidence.where((c("entity_type") == "COMPANY") & (c("field") == "industry")).select(
        c("entity_id").alias("company_id"), F.coalesce(value_string(c("value_json")), c("value_json")).alias("value"), F.when(F.size(sourced) == 1, text_key(F.get(sourced, F.lit(0)))).alias("term"), c("id").alias("evidence_id")
    )
    rows = one.where("term is not null").join(asked.select("icp_id", "company_id").distinct(), "company_id").join(need, "icp_id")
    return rows.where(F.array_contains("own", c("term"))).select("icp_id", "company_id", "value", "term", "evidence_id", "need")


def covered_by_keywords(evidence: DataFrame, asked: DataFrame, icps: DataFrame) -> DataFrame:
    """(icp_id, company_id, corroborated): the values of :func:`covering_sightings` that together cover what a profile needs."""
    rows = covering_sightings(evidence, asked, icps)
    made = rows.groupBy("icp_id", "company_id").agg(F.collect_set("term").alias("covered"), F.array_sort(F.collect_set("value")).alias("corroborated"), F.first("need").alias("need"))
    return made.where(F.size(F.array_except("need", "covered")) == 0).select("icp_id", "company_id", "corroborated")


def unprovable_industries(evidence: DataFrame, asked: DataFrame, icps: DataFrame) -> DataFrame:
    """(icp_id, company_id) with an industry row that is no term of the profile but came by a branch of its terms: which of them holds is not known."""
    c = F.col
    branch = read_provenance(c("evidence_text"))["industry_match"]["icp_terms"]
    rows = evidence.where((c("entity_type") == "COMPANY") & (c("field") == "industry")).select(
        c("entity_id").alias("company_id"), text_key(F.coalesce(value_string(c("value_json")), c("value_json"))).alias("value"), F.transform(branch, text_key).alias("branch")
    )
    rows = rows.where("branch is not null").distinct().join(asked.select("icp_id", "company_id").distinct(), "company_id").join(icps.select("icp_id", _terms("industries").alias("own")), "icp_id")
    return rows.where(~F.array_contains("own", c("value")) & F.arrays_overlap("branch", "own")).select("icp_id", "company_id").distinct()


def described(evidence: DataFrame, asked: DataFrame, icps: DataFrame, terms: str) -> DataFrame:
    """(icp_id, company_id, stated) where a company's descriptions contain every term of the profile's list ``terms``; stated is its first.

    A term counts where one description contains it; it never runs from one
    into the next, whose order is not defined.
    """
    c = F.col
    lists = icps.where(F.size(terms) > 0).select("icp_id", _terms(terms).alias("need"), F.get(terms, F.lit(0)).alias("stated"))
    texts = evidence.where((c("entity_type") == "COMPANY") & (c("field") == "description")).select(c("entity_id").alias("company_id"), text_key(value_string(c("value_json"))).alias("text")).where("text <> ''").distinct()
    rows = texts.join(asked.select("icp_id", "company_id").distinct(), "company_id").join(lists, "icp_id")
    found = rows.select("icp_id", "company_id", "need", "stated", F.explode(F.filter("need", lambda t: (t != "") & F.contains(c("text"), t))).alias("term"))
    made = found.groupBy("icp_id", "company_id").agg(F.count_distinct("term").alias("n"), F.max(F.size("need")).alias("of"), F.first("stated").alias("stated"))
    return made.where("n = of").select("icp_id", "company_id", "stated")


def decided(asked: DataFrame, icps: DataFrame, evidence: DataFrame, status: DataFrame) -> DataFrame:
    """Each asked row with the candidate its evidence makes, and with what every value came from.

    industry_by and type_by say whether a value is that of the FIELD, was
    CORROBORATED by several sightings, or is what descriptions state
    (DESCRIBED); null: an industry that cannot be proved and nothing replaces.
    """
    c = F.col
    company = eligible_fields(status.where(c("entity_type") == "COMPANY")).withColumnRenamed("entity_id", "company_id")
    people = status.where((c("entity_type") == "PERSON") & c("field").isin("company_association", "current_title"))
    person = people.groupBy(c("entity_id").alias("person_id")).agg(
        F.max(F.when((c("field") == "company_association") & (c("status") == "SUPPORTED"), value_string(c("value")))).alias("at_company"),
        F.max(F.when((c("field") == "current_title") & c("status").isin(*ELIGIBLE), F.coalesce(value_string(c("value")), c("value")))).alias("held_title"),
    )
    pair = ["icp_id", "company_id"]
    rows = asked.join(company, "company_id", "left").join(person, "person_id", "left")
    rows = rows.join(covered_by_keywords(evidence, asked, icps), pair, "left")
    rows = rows.join(unprovable_industries(evidence, asked, icps).withColumn("unprovable", F.lit(True)), pair, "left")
    rows = rows.join(described(evidence, asked, icps, "industries").withColumnRenamed("stated", "stated_industry"), pair, "left")
    rows = rows.join(described(evidence, asked, icps, "company_types").withColumnRenamed("stated", "stated_type"), pair, "left")
    suppressed = c("unprovable").isNotNull() & c("corroborated").isNull() & c("industry").isNotNull()
    proved = F.when(~suppressed, c("industry"))
    industry_by = (
        F.when(proved.isNotNull(), "FIELD").when(c("corroborated").isNotNull(), "CORROBORATED").when(c("stated_industry").isNotNull(), "DESCRIBED").when(~suppressed, "FIELD")
    )
    type_by = F.when(c("company_type").isNull() & c("stated_type").isNotNull(), "DESCRIBED").otherwise("FIELD")
    at_this = F.coalesce(c("at_company") == c("company_id").cast("string"), F.lit(False))
    return rows.withColumns({"industry_by": industry_by, "type_by": type_by, "at_this": at_this}).withColumns({
        "industry": F.coalesce(proved, F.get("corroborated", F.lit(0)), c("stated_industry")), "company_type": F.coalesce("company_type", "stated_type"),
        "employee_count": c("employee_count").try_cast("int"), "title": F.when(at_this, c("held_title")),
    })


def validate(asked: DataFrame, icps: DataFrame, evidence: DataFrame, status: DataFrame) -> DataFrame:
    """Each asked (icp_id, company_id, person_id; null: no person) judged by its evidence: results, overall, reasons.

    ``icps`` are profiles with industries, combinations (terms that need no
    proof of their own) and the columns of ``rules.evaluate``; ``evidence``
    has entity_type, entity_id, field, value_json, evidence_text and id, and
    ``status`` is its field status with values. An industry that cannot be
    proved, or is missing, may be replaced by corroborated terms, then by
    what descriptions state. A person's title counts only if its association
    with this very company is SUPPORTED; without a person the title rule does
    not apply. Without evidence everything holds that the profile constrains.
    """
    c = F.col
    rows = decided(asked, icps, evidence, status).join(profile_keys(icps), "icp_id")
    # What was corroborated counts as allowed.
    widened = F.array_union("industry_keys", F.transform(F.coalesce("corroborated", _none()), text_key))
    rows = rows.withColumns({"industry_keys": F.when(F.size("industry_keys") > 0, widened).otherwise(c("industry_keys")), "title_keys": F.when(c("person_id").isNull(), _none()).otherwise(c("title_keys"))})
    return judged(rows).select("icp_id", "company_id", "person_id", "results", "overall", "reasons")


def cited_rows(asked: DataFrame, icps: DataFrame, evidence: DataFrame, status: DataFrame) -> DataFrame:
    """(icp_id, company_id, person_id, rule, evidence_id): the rows of the branch that decided each rule.

    A rule cites the rows of its eligible field; the employee rule those of the
    count where the candidate has one, else of the range. An industry cites the
    sightings that corroborated it, or the descriptions that state it, where
    those decided in the field's place, and nothing if it could not be proved.
    The title rule cites the person's titles if they count. Exclusions cite
    whatever the company's name, domain, industry, place and type, and the
    title, rest on, each row once. Citations are rows: a field may have any
    number of them.
    """
    c = F.col
    field = lambda entity, name: F.struct(entity.cast("string").alias("entity"), F.lit(name).alias("source"))
    company, person = c("company_id"), c("person_id")
    described_ = field(company, "DESCRIBED")
    industry = F.when(c("industry_by") == "FIELD", field(company, "industry")).when(c("industry_by") == "CORROBORATED", field(company, "CORROBORATED")).when(c("industry_by") == "DESCRIBED", described_)
    kind = F.when(c("type_by") == "FIELD", field(company, "company_type")).otherwise(described_)
    title = F.when(c("at_this"), field(person, "current_title"))
    place = field(company, "country")
    bases = {
        "industry": F.array(industry), "geography": F.array(place), "company_type": F.array(kind), "allowed_titles": F.array(title),
        "employee_range": F.array(F.when(c("employee_count").isNotNull(), field(company, "employee_count")).otherwise(field(company, "employee_range"))),
        "exclusions": F.array_distinct(F.array(field(company, "company_identity"), field(company, "domain"), industry, place, kind, title)),
    }

    def of(rule: str) -> Column:
        return F.transform(F.array_compact(bases[rule]), lambda s: F.struct(F.lit(rule).alias("rule"), s["entity"].alias("entity"), s["source"].alias("source")))

    every = F.flatten(F.array(*map(of, bases)))
    keys = ["icp_id", "company_id", "person_id"]
    wanted = decided(asked, icps, evidence, status).select(*keys, F.explode(every).alias("w")).select(*keys, "w.*")

    good = status.where(c("status").isin(*ELIGIBLE)).select("entity_type", "entity_id", "field")
    fields = evidence.join(good, ["entity_type", "entity_id", "field"]).where((c("entity_type") == "PERSON") == (c("field") == "current_title"))
    texts = evidence.where((c("entity_type") == "COMPANY") & (c("field") == "description") & (value_string(c("value_json")) != ""))
    pool = fields.select(c("entity_id").alias("entity"), c("field").alias("source"), c("id").alias("evidence_id")).unionByName(texts.select(c("entity_id").alias("entity"), F.lit("DESCRIBED").alias("source"), c("id").alias("evidence_id")))
    seen = covering_sightings(evidence, asked, icps).select("icp_id", c("company_id").cast("string").alias("entity"), "evidence_id")
    out = [*keys, "rule", "evidence_id"]
    covered = wanted.where("source = 'CORROBORATED'").join(seen, ["icp_id", "entity"]).select(*out)
    return wanted.where("source <> 'CORROBORATED'").join(pool, ["entity", "source"]).select(*out).unionByName(covered)


def profile_errors(icps: DataFrame) -> DataFrame:
    """Adds errors: what contradicts itself in a raw profile; empty for a valid one. Nothing is corrected in silence.

    Takes industries, geography, company_types, titles, excluded and
    preferences (arrays, null: empty), min_employees and max_employees.
    """
    c = F.col
    raw = lambda n: F.coalesce(n, _none())
    keys = lambda n: F.filter(F.transform(raw(n), text_key), lambda t: t != "")
    bare = (F.size(raw("industries")) + F.size(raw("geography")) + F.size(raw("company_types")) + F.size(raw("titles")) + F.size(raw("excluded"))) == 0
    allowed = F.concat(keys("industries"), keys("geography"), keys("company_types"), keys("titles"))
    errors = F.array_compact(F.array(
        F.when(c("min_employees") > c("max_employees"), "EMPLOYEE_RANGE_REVERSED"),
        F.when(bare & c("min_employees").isNull() & c("max_employees").isNull() & (F.size(raw("preferences")) == 0), "PROFILE_EMPTY"),
        F.when(F.size(F.array_distinct(keys("geography"))) < F.size(keys("geography")), "GEOGRAPHY_REPEATED"),
        F.when(F.coalesce(F.arrays_overlap(keys("excluded"), allowed), F.lit(False)), "EXCLUSION_IS_ALLOWED"),
    ))
    return icps.withColumn("errors", errors)


def canonical_profiles(icps: DataFrame, clean, country) -> DataFrame:
    """Profiles in canonical form: every list cleaned, places split into countries (each code once, with the text that named it first) and others.

    ``clean`` and ``country`` are the column functions for term lists and for
    country codes. Takes the columns of :func:`profile_errors`; labels of
    custom rules (custom_rules), where there are any, are cleaned and all kept.
    """
    c = F.col
    places = clean(F.coalesce("geography", _none()))
    coded = F.filter(F.transform(places, lambda p: F.struct(country(p).alias("code"), p.alias("raw"))), lambda s: s["code"].isNotNull())
    codes = F.array_distinct(F.transform(coded, lambda s: s["code"]))
    tidy = lambda n: clean(F.coalesce(n, _none())).alias(n)
    labels = [F.transform(F.coalesce("custom_rules", _none()), clean_text).alias("custom_rules")] if "custom_rules" in icps.columns else []
    made = icps.select(
        "icp_id", *[tidy(n) for n in ("industries", "titles", "company_types", "excluded", "preferences")], "min_employees", "max_employees", codes.alias("country_codes"),
        F.transform(codes, lambda k: F.get(F.filter(coded, lambda s: s["code"] == k), F.lit(0))["raw"]).alias("country_texts"), F.filter(places, lambda p: country(p).isNull()).alias("other_places"), *labels,
    )
    return made
