"""Leads put together from their histories: signals, exports, review leads and the review queue.

Each history is brought to its latest row by key, a partial aggregate, before
it meets the leads; keys match null-safely, as a lead may have no person.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import discard, lean_cut
from .ranking import latest, rank_leads, tier_reasons

# The scores that order leads of one tier.
SCORES = ("final_score", "company_quality_score", "evidence_score", "qualification_confidence")


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on null-safe keys; the right side's other columns come along."""
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(other, same, "left").drop(*[f"__{k}" for k in keys])


def _last(history: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """The latest row of a history (at, id) by key: ``values`` names its columns and what they are called then."""
    top = latest(history.select(*keys, "at", "id", *[v for v in values if v != "id"]), keys, "at", "id")
    return top.select(*keys, *[F.col(v).alias(name) for v, name in values.items()])


def tagged(histories: dict[str, tuple[DataFrame, list[str], dict[str, str]]]) -> DataFrame:
    """The latest row of every history by key, all in one table, one aggregate and one shuffle.

    A history is its rows (at, id, keys, values), its keys and what its values
    are called then. Rows go by what they are keyed by (scope) and their keys
    as text (k0, k1, ...); each history has a column of that name, a struct of
    its values, null where the key has none of it.
    """
    slots = max(len(keys) for _, keys, _ in histories.values())
    one, kept = [], []
    for name, (df, keys, values) in histories.items():
        held = F.struct(F.struct("at", "id").alias("o"), F.struct(*[F.col(v).alias(n) for v, n in values.items()]).alias("v")).alias(name)
        text = [(F.col(keys[k]).cast("string") if k < len(keys) else F.lit(None).cast("string")).alias(f"k{k}") for k in range(slots)]
        one.append(df.select(F.lit(",".join(keys)).alias("scope"), *text, held))
        kept.append(F.max_by(F.col(name)["v"], F.col(name)["o"]).alias(name))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one)
    return every.groupBy("scope", *[f"k{k}" for k in range(slots)]).agg(*kept)


def _looked_up(rows: DataFrame, told: DataFrame, scope: list[str], keys: list[str], names: dict[str, str]) -> DataFrame:
    """``rows`` with the values of the named histories of :func:`tagged`; a name in ``names`` that is not its own stays a struct."""
    right = told.where(F.col("scope") == ",".join(scope)).select(*[F.col(f"k{k}").alias(f"__k{k}") for k in range(len(keys))], *[F.col(n).alias(f"__v_{n}") for n in names])
    same = reduce(lambda a, b: a & b, [F.col(key).cast("string").eqNullSafe(F.col(f"__k{k}")) for k, key in enumerate(keys)])
    made = rows.join(right, same, "left").drop(*[f"__k{k}" for k in range(len(keys))])
    out = [c for c in made.columns if not c.startswith("__v_")]
    return made.select(*out, *[x for n, called in names.items() for x in ([F.col(f"__v_{n}.*")] if n == called else [F.col(f"__v_{n}").alias(called)])])


LEAD, COMPANY = ["icp_id", "company_id", "person_id"], ["icp_id", "company_id"]


def lead_signals(members: DataFrame, validations: DataFrame, scores: DataFrame, quality: DataFrame, verdicts: DataFrame, second: DataFrame, reviews: DataFrame, items: DataFrame, conflicts: DataFrame, verifications: DataFrame) -> DataFrame:
    """All signals of each member (icp_id, lead_id, company_id, person_id), by the latest row of each history.

    ``second`` are adversarial reviews of a verdict (qualification_id);
    ``conflicts`` the entities (entity_id) with a conflict, ``verifications``
    every one ever made (entity_id, outcome): one that was ever left open
    counts. A member that repeats is one lead.
    """
    c = F.col
    parts = ("final_score", "icp_score", "commercial_score", "evidence_score", "freshness_score", "identity_confidence")
    opened = verifications.where(c("outcome").isin("UNRESOLVED", "HOLD"))
    flag = lambda df, name: df.where("entity_id is not null").select("entity_id", F.lit(0).alias("at"), F.lit(0).alias("id"), F.lit(True).alias(name))
    told = lean_cut(tagged({
        "validation": (validations, LEAD, {"overall": "hard_rule_result", "reasons": "hard_rule_reason_codes", "id": "hard_validation_id"}),
        "score": (scores, LEAD, {p: p for p in parts} | {"id": "score_id"}),
        "verdict": (verdicts, LEAD, {"decision": "qualification_decision", "confidence": "qualification_confidence", "summary": "qualification_summary", "id": "qualification_id"}),
        "quality": (quality, COMPANY, {"score": "company_quality_score", "label": "company_quality_label"}),
        "second": (second.where("qualification_id is not null"), ["qualification_id"], {"result": "adversarial_result", "confidence": "adversarial_confidence", "id": "adversarial_review_id"}),
        "review": (reviews, ["icp_id", "lead_id"], {"decision": "human_review_decision", "reasons": "human_review_reason_codes", "id": "human_review_id"}),
        "item": (items.where("lead_id is not null"), ["lead_id"], {"outcome": "batch_outcome"}),
        "conflict": (flag(conflicts, "conflict"), ["entity_id"], {"conflict": "conflict"}), "open": (flag(opened, "open"), ["entity_id"], {"open": "open"}),
    }), "histories")
    rows = members.select("icp_id", "lead_id", "company_id", "person_id").distinct()
    # A table every few lookups, so that what they shuffle is never on disk all at once.
    for keys, names in ((LEAD, ("validation", "score", "verdict")), (COMPANY, ("quality",))):
        rows = _looked_up(rows, told, keys, keys, {n: n for n in names})
    first = rows = lean_cut(rows, "judged")
    for keys, names in ((["qualification_id"], ("second",)), (["icp_id", "lead_id"], ("review",)), (["lead_id"], ("item",))):
        rows = _looked_up(rows, told, keys, keys, {n: n for n in names})
    rows = lean_cut(rows, "reviewed")
    discard(first)
    for key in ("company_id", "person_id"):
        rows = _looked_up(rows, told, ["entity_id"], [key], {"conflict": f"conflict_{key}", "open": f"open_{key}"})
    either = lambda name: F.coalesce(f"{name}_company_id.{name}", f"{name}_person_id.{name}", F.lit(False))
    rows = rows.withColumns({"evidence_has_conflicts": either("conflict"), "verification_unresolved": either("open")})
    return rows.drop(*[f"{n}_{k}" for n in ("conflict", "open") for k in ("company_id", "person_id")])


def ranked(signals: DataFrame) -> DataFrame:
    """Adds tier, rank (1..n in each profile) and ranking_reason_codes to the rows of :func:`lead_signals`."""
    made = rank_leads(signals, list(SCORES)).withColumnRenamed("position", "rank")
    return made.withColumn("ranking_reason_codes", tier_reasons())


def export_leads(leads: DataFrame, companies: DataFrame, people: DataFrame, fields: DataFrame, verified: DataFrame, ids: dict[str, DataFrame], resolutions: dict[str, DataFrame], profile: dict[str, Column]) -> DataFrame:
    """Ranked leads with identity, evidence and provenance, ready for ``sources.export``.

    ``companies`` has company_id, name, domain, provider_ids; ``people``
    person_id, name, profile_id, provider_ids; ``fields`` (lead_id,
    conflicting, missing) and ``verified`` (lead_id, verified) as of
    :mod:`evidence`. ``ids`` gives the lists of a lead (lead_id, id) that
    provenance names: evidence_ids, verification_ids and deduplication_ids;
    ``resolutions`` one id of a company or person (company_id or person_id,
    id). ``profile`` are the columns that a run fixes: schema_version,
    icp_version, batch_id, exported_at. A person's title is never known here.
    """
    c, empty = F.col, F.array().cast("array<string>")
    firms = companies.select("company_id", c("name").alias("company_name"), c("domain").alias("company_domain"), F.map_keys("provider_ids").alias("__pc"))
    persons = people.select("person_id", c("name").alias("person_name"), c("profile_id").alias("person_linkedin_id"), F.map_keys("provider_ids").alias("__pp"))
    # What is keyed alike is joined in one shuffle of the leads, and a table follows, so that only one such shuffle is on disk at a time.
    rows = leads
    for key, named in (("company_id", firms), ("person_id", persons)):
        before, rows = rows, rows.join(named, key, "left")
        for name, df in resolutions.items():
            if name.startswith(key.split("_")[0]):
                rows = rows.join(df.groupBy(key).agg(F.max("id").alias(name)), key, "left")
        rows = lean_cut(rows, "named")
        if before is not leads:
            discard(before)
    rows = rows.join(fields.select("lead_id", c("conflicting").alias("evidence_conflicting_fields"), c("missing").alias("evidence_missing_critical_fields")), "lead_id", "left").join(verified, "lead_id", "left")
    # All lists of a lead's ids are dealt by lead once, before anything is gathered.
    given = reduce(lambda a, b: a.unionByName(b), [df.select("lead_id", F.lit(k).alias("list"), c("id").cast("string").alias("id")) for k, df in enumerate(ids.values())])
    lists = given.repartition("lead_id").groupBy("lead_id").agg(*[F.array_sort(F.collect_set(F.when(c("list") == k, c("id")))).alias(name) for k, name in enumerate(ids)])
    rows = rows.join(lists, "lead_id", "left").withColumns({name: F.coalesce(name, empty) for name in ids})
    return rows.withColumns(profile | {
        "person_title": F.lit(None).cast("string"), "is_duplicate_occurrence": c("tier") == "DUPLICATE", "verification_status": F.when(c("verification_unresolved"), "UNRESOLVED"),
        "source_provider_ids": F.array_union(F.coalesce("__pc", empty), F.coalesce("__pp", empty)), "hard_rule_reason_codes": F.coalesce("hard_rule_reason_codes", empty),
        "human_review_reason_codes": F.coalesce("human_review_reason_codes", empty), "verified": F.coalesce("verified", F.create_map().cast("map<string,string>")),
    }).drop("__pc", "__pp")


def latest_values(evidence: DataFrame, fields: tuple[str, ...], key: str = "entity_id") -> DataFrame:
    """One row an entity: the newest value of each of ``fields`` (text), by time and id."""
    c = F.col
    return evidence.where(c("field").isin(*fields)).groupBy(key).agg(*[F.max_by(F.when(c("field") == f, c("value")), F.when(c("field") == f, F.struct("retrieved_at", "id"))).alias(f) for f in fields])


PERSON_FIELDS = ("current_title", "email", "email_status", "phone", "linkedin_url", "linkedin_id")


def review_leads(exported: DataFrame, people: DataFrame, person_evidence: DataFrame, company_profiles: DataFrame) -> DataFrame:
    """What reviewers see of exported leads: the newest of what is known of the person, links to profiles, and whether the person was enriched.

    ``people`` has person_id and profile_id; ``company_profiles`` company_id
    and linkedin_id.
    """
    c = F.col
    newest = latest_values(person_evidence, PERSON_FIELDS).withColumnRenamed("entity_id", "person_id")
    rows = exported.join(newest, "person_id", "left").join(people.select("person_id", c("profile_id").alias("__profile")), "person_id", "left")
    rows = rows.join(company_profiles.groupBy("company_id").agg(F.min("linkedin_id").alias("__company")), "company_id", "left")
    link = lambda id_, at: F.when(id_.isNotNull(), F.concat(F.lit(at), id_))
    return rows.select(
        "lead_id", "company_name", "company_domain", link(c("__company"), "https://linkedin.com/").alias("company_linkedin_url"), "person_name", c("current_title").alias("title"), "email", "email_status", "phone",
        F.coalesce("linkedin_url", link(F.coalesce("__profile", "linkedin_id"), "https://linkedin.com/in/")).alias("person_linkedin_url"), "tier", "final_score", "qualification_decision",
        F.when(c("email").isNotNull() | c("linkedin_url").isNotNull(), "enriched").otherwise("not enriched").alias("enrichment_status"), "rank",
    )


def matches_review(query: Column, tier: Column, enrichment: Column, shown_tier: Column) -> Column:
    """Whether a review lead meets a search text over five of its fields, a display tier and an enrichment state; ``all`` meets all.

    Filters are plain columns, so that literals reach the scan.
    """
    c = F.col
    text = F.lower(F.concat_ws(" ", *[F.nullif(c(x), F.lit("")) for x in ("company_name", "person_name", "title", "email", "company_domain")]))
    found = (F.trim(query) == "") | F.contains(text, F.lower(F.trim(query)))
    return found & ((tier == "all") | F.coalesce(shown_tier == tier, F.lit(False))) & ((enrichment == "all") | (c("enrichment_status") == F.when(enrichment == "enriched", "enriched").otherwise("not enriched")))


def review_queue(members: DataFrame, snapshots: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row a membership (lead_id, icp_id, icp_version): its lead's snapshot, whether it was reviewed, and the latest decision."""
    keys = ["icp_id", "lead_id"]
    rows = _joined(members.select("lead_id", "icp_id", "icp_version").distinct(), snapshots, keys)
    rows = _joined(rows, _last(reviews, keys, {"decision": "latest_review_decision", "id": "__review"}), keys)
    return rows.withColumn("already_reviewed", F.col("__review").isNotNull()).drop("__review")


def history(rows: DataFrame, time: str = "at", tie: str = "id", **wanted: str | None) -> DataFrame:
    """A history narrowed to the given keys (None: any), oldest first."""
    for key, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(key) == value)
    return rows.orderBy(time, tie)


def verdict_context(leads: DataFrame, evidence: DataFrame, most: int = 40, chars: int = 300) -> DataFrame:
    """(lead_id, context): what a judge is told of each lead, as JSON with sorted keys.

    ``leads`` has lead_id, company_id, person_id and any summaries, which are
    named by their columns. Of its evidence (entity_type, entity_id, field,
    value, confidence, retrieved_at, id) the first row of each different
    value, the company's before the person's, ``most`` in all, each value cut
    at ``chars``: limits of the context itself. Every entity gives at most
    ``most`` rows before it meets its leads.
    """
    c = F.col
    distinct = evidence.groupBy("entity_type", "entity_id", "field", "value").agg(F.min(F.struct("retrieved_at", "id", "confidence")).alias("f"))
    item = F.struct(c("f.retrieved_at").alias("at"), c("f.id").alias("id"), c("field"), F.substring(F.coalesce("value", F.lit("null")), 1, chars).alias("value"), c("f.confidence").alias("confidence"))
    own = _smallest(distinct.select("entity_type", "entity_id", item.alias("item")), ["entity_type", "entity_id"], "item", most)
    side = lambda kind, key: own.where(c("entity_type") == kind).select(c("entity_id").alias(key), c("items").alias(f"__{key}"))
    rows = leads.join(side("COMPANY", "company_id"), "company_id", "left").join(side("PERSON", "person_id"), "person_id", "left")
    kind = "array<struct<at:timestamp,id:string,field:string,value:string,confidence:string>>"
    both = F.slice(F.concat(F.coalesce("__company_id", F.array().cast(kind)), F.coalesce("__person_id", F.array().cast(kind))), 1, most)
    briefs = F.transform(both, lambda i: F.struct(i["confidence"].alias("confidence"), i["field"].alias("field"), i["id"].alias("id"), i["value"].alias("value")))
    named = sorted([x for x in leads.columns if x != "lead_id"] + ["evidence"])
    return rows.withColumn("evidence", briefs).select("lead_id", F.to_json(F.struct(*named), {"ignoreNullFields": "false"}).alias("context"))


def _smallest(rows: DataFrame, keys: list[str], item: str, most: int) -> DataFrame:
    """The ``most`` least items of each key, in order, as an array: a rank that Spark limits before it shuffles."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(item))
    top = rows.withColumn("__n", nth).where(F.col("__n") <= most)
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
