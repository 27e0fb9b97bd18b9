"""Evidence rows to one status per entity and field, and to summaries of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_json, clean_text, country_code

# The fields that count for completeness, those that one trusted source may state alone, and places.
COMPANY_CRITICAL = ("company_identity", "domain", "industry", "employee_range", "country", "company_type", "business_model", "linkedin_id", "revenue_range")
PERSON_CRITICAL = ("person_identity", "current_title", "company_association", "linkedin_id")
STRUCTURED_FIELDS = ("industry", "country", "employee_range", "company_type")
PLACE_FIELDS = ("country", "geography")
ELIGIBLE = ("SUPPORTED", "SUPPORTED_STRUCTURED")

ENTITY = ["entity_type", "entity_id"]
FIELD = [*ENTITY, "field"]


def value_string(value_json: Column) -> Column:
    """The text of a JSON string; null for any other value."""
    return F.when(F.substring(F.ltrim(value_json), 1, 1) == '"', F.get_json_object(F.concat(F.lit('{"v":'), value_json, F.lit("}")), "$.v"))


def comparison_key(field: Column, value_json: Column) -> Column:
    """What two JSON values must share to agree: for text its country's code in place fields, else the cleaned lower-case text; for others the sorted JSON."""
    text = value_string(value_json)
    place = F.when(field.isin(*PLACE_FIELDS), F.concat(F.lit("geo:"), country_code(text)))
    return F.when(text.isNotNull(), F.coalesce(place, F.lower(clean_text(text)))).otherwise(canonical_json(F.coalesce(value_json, F.lit("null"))))


def field_status(evidence: DataFrame, trusted: tuple[str, ...] = (), fields: tuple[str, ...] = STRUCTURED_FIELDS) -> DataFrame:
    """One row for each entity_type, entity_id and field with its status.

    Takes key (see comparison_key; a null one is a value like any other),
    confidence, provider, retrieved_at and id; with a column value, the value
    of the first row by time and id comes along. All sums are partial before
    the one shuffle, so an entity of very many rows is one row a task.
    """
    key = F.coalesce(F.concat(F.lit("="), "key"), F.lit("null"))
    valued = "value" in evidence.columns
    first = [F.min(F.struct("retrieved_at", "id", "value")).alias("first")] if valued else []
    made = evidence.groupBy(*FIELD).agg(
        F.count("*").alias("n_rows"), F.min(key).alias("low"), F.max(key).alias("high"), F.max("confidence").alias("one_confidence"),
        F.max("provider").alias("one_provider"), F.max("retrieved_at").alias("newest"), F.min("provider").alias("a_provider"), *first,
    )
    several = F.col("low") != F.col("high")
    alone = F.col("n_rows") == 1
    status = (
        F.when(several, "CONFLICT").when(F.col("n_rows") >= 2, "SUPPORTED").when(alone & F.col("one_confidence").isin("MEDIUM", "HIGH"), "SUPPORTED")
        .when(alone & F.col("one_provider").isin(*trusted) & F.col("field").isin(*fields), "SUPPORTED_STRUCTURED").otherwise("INSUFFICIENT")
    )
    corroborated = F.coalesce(F.col("a_provider") != F.col("one_provider"), F.lit(False))
    return made.select(*FIELD, status.alias("status"), "n_rows", "newest", corroborated.alias("corroborated"), *([F.col("first.value").alias("value")] if valued else []))


def freshness_score(newest: Column, now: Column, fresh_days: float = 30.0, stale_days: float = 180.0) -> Column:
    """100 up to fresh_days, 0 from stale_days, linear between; null without rows."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(newest.cast("timestamp"))) / 86_400_000_000.0
    return F.when(age <= fresh_days, 100.0).when(age >= stale_days, 0.0).otherwise(100.0 * (stale_days - age) / (stale_days - fresh_days))


def is_stale(freshness: Column) -> Column:
    """Out of date; unknown freshness is not. It never changes a status."""
    return F.coalesce(freshness <= 0, F.lit(False))


def critical_rows(entities: DataFrame, company: tuple[str, ...] = COMPANY_CRITICAL, person: tuple[str, ...] = PERSON_CRITICAL) -> DataFrame:
    """(entity_type, entity_id, field) for each critical field of each entity."""
    lists = F.when(F.col("entity_type") == "PERSON", F.array(*map(F.lit, person))).otherwise(F.array(*map(F.lit, company)))
    return entities.select(*ENTITY).distinct().select(*ENTITY, F.explode(lists).alias("field"))


def all_fields(status: DataFrame, entities: DataFrame, company: tuple[str, ...] = COMPANY_CRITICAL, person: tuple[str, ...] = PERSON_CRITICAL) -> DataFrame:
    """The status rows of ``entities`` with critical (boolean) and a row UNKNOWN for each critical field that has no evidence."""
    wanted = critical_rows(entities, company, person).withColumn("critical", F.lit(True))
    own = status.join(entities.select(*ENTITY).distinct(), ENTITY, "left_semi")
    made = own.join(wanted, FIELD, "full")
    return made.withColumns({"critical": F.coalesce("critical", F.lit(False)), "status": F.coalesce("status", F.lit("UNKNOWN")), "n_rows": F.coalesce("n_rows", F.lit(0))})


def entity_summary(status: DataFrame, critical: tuple[str, ...], entities: DataFrame | None = None) -> DataFrame:
    """One row an entity: completeness over the critical fields, conflicting and missing fields.

    Absent fields are UNKNOWN, and only those are missing. With ``entities``
    (entity_type, entity_id), those without evidence have a row too.
    """
    covered = F.col("field").isin(*critical)
    made = status.groupBy(*ENTITY).agg(
        F.count(F.when(covered, 1)).alias("n_covered"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "CONFLICT", F.col("field")))).alias("conflicting"),
        F.collect_list(F.when(covered, F.col("field"))).alias("seen"),
        F.max("newest").alias("newest"),
    )
    if entities is not None:
        made = entities.select(*ENTITY).distinct().join(made, ENTITY, "left")
    empty = F.array().cast("array<string>")
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, critical)), F.coalesce("seen", empty)))
    return made.select(*ENTITY, (F.coalesce("n_covered", F.lit(0)) / len(critical)).alias("completeness"), F.coalesce("conflicting", empty).alias("conflicting"), missing.alias("missing"), "newest")


def lead_fields(leads: DataFrame, companies: DataFrame, people: DataFrame) -> DataFrame:
    """(lead_id, conflicting, missing): the lists of a lead's company, then of its person, each name once.

    ``leads`` has lead_id, company_id and person_id (null: none);
    ``companies`` and ``people`` are summaries. A company without evidence
    lacks every critical field, and so does a person.
    """
    empty = F.array().cast("array<string>")
    side = lambda df, key, tag: df.select(F.col("entity_id").alias(key), F.col("conflicting").alias(f"c_{tag}"), F.col("missing").alias(f"m_{tag}"))
    rows = leads.join(side(companies, "company_id", "c"), "company_id", "left").join(side(people, "person_id", "p"), "person_id", "left")
    all_of = lambda names: F.array(*map(F.lit, sorted(names)))
    m_p = F.when(F.col("person_id").isNull(), empty).otherwise(F.coalesce("m_p", all_of(PERSON_CRITICAL)))
    return rows.select(
        "lead_id", F.array_distinct(F.concat(F.coalesce("c_c", empty), F.coalesce("c_p", empty))).alias("conflicting"),
        F.array_distinct(F.concat(F.coalesce("m_c", all_of(COMPANY_CRITICAL)), m_p)).alias("missing"),
    )


def supported_values(leads: DataFrame, status: DataFrame) -> DataFrame:
    """(lead_id, verified): map of field to value for what is SUPPORTED, structured support not counting; a person's fields are named ``person.``.

    ``status`` is that of :func:`field_status` with values. A lead without
    such fields has an empty map. A lead has at most one entry a field.
    """
    good = status.where(F.col("status") == "SUPPORTED")
    name = F.when(F.col("entity_type") == "PERSON", F.concat(F.lit("person."), "field")).otherwise(F.col("field"))
    per = good.groupBy(*ENTITY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("field"), F.coalesce("value", F.lit("null")).alias("value"))))).alias("own"))
    side = lambda kind, key: per.where(F.col("entity_type") == kind).select(F.col("entity_id").alias(key), F.col("own").alias(f"own_{key}"))
    rows = leads.join(side("COMPANY", "company_id"), "company_id", "left").join(side("PERSON", "person_id"), "person_id", "left")
    none = F.create_map().cast("map<string,string>")
    return rows.select("lead_id", F.map_concat(F.coalesce("own_company_id", none), F.coalesce("own_person_id", none)).alias("verified"))


def conflicting_facts(facts: DataFrame) -> DataFrame:
    """For each company_id and field of ``facts`` (value_json): rows and whether different values are stated, compared as sorted JSON."""
    key = canonical_json(F.coalesce("value_json", F.lit("null")))
    made = facts.select("company_id", "field", key.alias("key")).groupBy("company_id", "field").agg(F.count("*").alias("n_facts"), (F.min("key") != F.max("key")).alias("conflict"))
    return made


def supporting_evidence(fields: DataFrame, evidence: DataFrame) -> DataFrame:
    """(entity_type, entity_id, field, status, evidence_id), one row for each row that backs a critical field; UNKNOWN fields have a null id.

    ``fields`` is that of :func:`all_fields`. Ids stay in rows, not in an
    array: a field may have been seen any number of times.
    """
    ids = evidence.select(*FIELD, F.col("id").alias("evidence_id"))
    return fields.where("critical").select(*FIELD, "status").join(ids, FIELD, "left")


def verify_fields(status: DataFrame, evidence: DataFrame, responses: DataFrame, providers: DataFrame, trusted: tuple[str, ...] = ()) -> DataFrame:
    """What asking further providers about unsettled fields gives: (entity_type, entity_id, field, trigger, execution, outcome, original_status, resulting_status, n_new).

    Fields on CONFLICT or INSUFFICIENT take the rows of ``responses`` (as
    evidence; stored answers) from those of ``providers`` (provider; few) that
    they have no evidence of yet. Others are NOT_TRIGGERED.
    """
    c = F.col
    opened = status.where(c("status").isin("CONFLICT", "INSUFFICIENT")).select(*FIELD)
    used = evidence.join(opened, FIELD, "left_semi").select(*FIELD, "provider").where("provider is not null").distinct()
    names = providers.select("provider").distinct()
    free, n_all = used.join(names, "provider", "left_semi"), names.count()
    n_used = free.groupBy(*FIELD).agg(F.count("*").alias("n_used"))
    fresh = responses.join(opened, FIELD, "left_semi").join(names, "provider", "left_semi").join(used, [*FIELD, "provider"], "left_anti")
    columns = [*FIELD, "key", "confidence", "provider", "retrieved_at", "id"]
    fresh = fresh.withColumn("confidence", F.lit("UNKNOWN")).select(*columns)
    both = evidence.join(opened, FIELD, "left_semi").select(*columns).unionByName(fresh)
    again = field_status(both, trusted).select(*FIELD, c("status").alias("after"))
    new = fresh.groupBy(*FIELD).agg(F.count("*").alias("n_new"))
    rows = status.select(*FIELD, c("status").alias("original_status")).join(n_used, FIELD, "left").join(new, FIELD, "left").join(again, FIELD, "left")
    asked, got = c("original_status").isin("CONFLICT", "INSUFFICIENT"), F.coalesce(c("n_new"), F.lit(0)) > 0
    none_left = F.coalesce(c("n_used"), F.lit(0)) >= n_all
    execution = F.when(~asked, "NOT_TRIGGERED").when(none_left, "NO_INDEPENDENT_PROVIDERS").when(~got, "ALL_PROVIDERS_FAILED").otherwise("SUCCESS")
    after = F.when(asked & got, c("after")).otherwise(c("original_status"))
    outcome = F.when(asked, F.when(~got, "HOLD").when(after == "SUPPORTED", "RESOLVED").when(after == "CONFLICT", "HOLD").otherwise("UNRESOLVED"))
    return rows.select(
        *FIELD, F.when(asked, c("original_status")).alias("trigger"), execution.alias("execution"), outcome.alias("outcome"), "original_status", after.alias("resulting_status"),
        F.coalesce("n_new", F.lit(0)).alias("n_new"),
    )


def unseen(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose null-safe key is not stored yet, each key once: the same import twice adds nothing.

    Of rows with the same key the least by all other columns stays, so that
    the result is the same however the rows are dealt.
    """
    rest = [c for c in rows.columns if c not in keys]
    keep = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]) if rest else rows.distinct()
    cond = F.lit(True)
    for k in keys:
        cond = cond & keep[k].eqNullSafe(stored[k])
    return keep.join(stored, cond, "left_anti").select(*rows.columns)


def split_seen(candidates: DataFrame, seen: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Adds is_repeat: whether a candidate's (provider, external_id) was seen in its batch before."""
    keys = [batch, "provider_id", "external_id"]
    known = seen.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct().withColumn("__seen", F.lit(True))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return candidates.join(known, cond, "left").select(*candidates.columns, F.coalesce("__seen", F.lit(False)).alias("is_repeat"))
