"""What matched candidates add to the companies and people they matched.

All candidates of an entity are applied in order, set by set: a provider's
first id stays, an unseen name becomes an alias, and a domain goes to the first
company that claims it. Sums are partial, so a company of very many candidates
is one row a task for each of its different values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_domain, profile_id
from .entities import first_claims

NONE = "array<string>"


def _ord() -> Column:
    return F.struct(F.col("discovered_at").cast("timestamp").alias("at"), F.col("candidate_id").cast("string").alias("id"))


def _identities(rows: DataFrame, old: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The first id of each provider by entity, as maps with the old ones; and candidates that name another."""
    c = F.col
    kept = old.select(key, F.explode("provider_ids").alias("provider_id", "kept"))
    first = rows.where("provider_id is not null and external_id is not null").groupBy(key, "provider_id").agg(F.min_by("external_id", "ord").alias("first"))
    ids = first.join(kept, [key, "provider_id"], "full").select(key, "provider_id", F.coalesce("kept", "first").alias("own"))
    maps = ids.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider_id", "own")))).alias("provider_ids"))
    clash = rows.join(ids, [key, "provider_id"]).where(c("external_id") != c("own")).select("candidate_id", F.lit("provider_identity_conflict").alias("conflict"))
    return maps, clash


def _aliases(rows: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Names that an entity didn't have, by lower case, in the order in which they came."""
    c = F.col
    known = old.select(key, F.explode(F.array_append(F.coalesce("aliases", F.array().cast(NONE)), F.col("name"))).alias("name")).select(key, F.lower("name").alias("low")).distinct()
    new = rows.where("name is not null").groupBy(key, F.lower("name").alias("low")).agg(F.min(F.struct("ord", "name")).alias("first")).join(known, [key, "low"], "left_anti")
    return new.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("first")), lambda f: f["name"]).alias("added")).select(key, c("added"))


def _conflicts(candidates: DataFrame, *found: DataFrame) -> DataFrame:
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    lists = rows.groupBy("candidate_id").agg(F.array_sort(F.collect_set("conflict")).alias("conflicts"))
    return candidates.select("candidate_id").join(lists, "candidate_id", "left").select("candidate_id", F.coalesce("conflicts", F.array().cast(NONE)).alias("conflicts"))


def apply_company_matches(companies: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The companies after all matches, and the conflicts of each candidate.

    ``companies`` has company_id, name, domain, aliases and provider_ids (map);
    ``candidates`` those that matched: candidate_id, company_id, provider_id,
    external_id, name, domain, discovered_at. A company without a domain takes
    the first one of its candidates that no company has by then.
    """
    c, key = F.col, "company_id"
    rows = candidates.withColumns({"ord": _ord(), "domain": normalize_domain(c("domain"))})
    old = companies.withColumn("domain", normalize_domain(c("domain")))
    maps, clash = _identities(rows, old, key)
    taken = old.where("domain is not null").select("domain").distinct()
    open_rows = rows.join(old.where("domain is null").select(key), key, "left_semi").where("domain is not null").join(taken, "domain", "left_anti")
    claims = open_rows.select(c("ord"), F.array(F.concat(F.lit("c:"), c(key).cast("string")), F.concat(F.lit("d:"), "domain")).alias("keys"))
    won = open_rows.join(first_claims(claims), "ord", "left_semi").select(key, c("domain").alias("won"))
    made = old.join(won, key, "left").withColumn("domain", F.coalesce("domain", "won"))
    wrong = rows.where("domain is not null").join(made.select(key, c("domain").alias("own")), key).where(~c("domain").eqNullSafe(c("own"))).select("candidate_id", F.lit("domain_conflict").alias("conflict"))
    made = made.drop("provider_ids").join(maps, key, "left").join(_aliases(rows, old, key), key, "left")
    empty = F.array().cast(NONE)
    made = made.select(key, "name", "domain", F.concat(F.coalesce("aliases", empty), F.coalesce("added", empty)).alias("aliases"), F.coalesce("provider_ids", F.create_map().cast("map<string,string>")).alias("provider_ids"))
    return made, _conflicts(candidates, clash, wrong)


def apply_person_matches(people: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The people after all matches, and the conflicts of each candidate.

    ``people`` has person_id, name, aliases, provider_ids, profile_id,
    company_id and companies (array); ``candidates`` candidate_id, person_id,
    provider_id, external_id, name, company_id, attributes (map),
    discovered_at. New companies are appended; the first company and the first
    profile stay.
    """
    c, key = F.col, "person_id"
    empty = F.array().cast(NONE)
    rows = candidates.withColumns({"ord": _ord(), "profile": profile_id(c("attributes")), "at": F.nullif(c("company_id").cast("string"), F.lit(""))})
    maps, clash = _identities(rows, people, key)
    firsts = rows.groupBy(key).agg(F.min_by(F.when(c("at").isNotNull(), c("at")), F.when(c("at").isNotNull(), c("ord"))).alias("first_at"), F.min_by(F.when(c("profile").isNotNull(), c("profile")), F.when(c("profile").isNotNull(), c("ord"))).alias("first_profile"))
    seen = rows.where("at is not null").groupBy(key, "at").agg(F.min("ord").alias("ord")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "at"))), lambda s: s["at"]).alias("seen"))
    made = people.drop("provider_ids").join(maps, key, "left").join(firsts, key, "left").join(seen, key, "left").join(_aliases(rows, people, key), key, "left")
    made = made.select(
        key, "name", F.concat(F.coalesce("aliases", empty), F.coalesce("added", empty)).alias("aliases"), F.coalesce("provider_ids", F.create_map().cast("map<string,string>")).alias("provider_ids"),
        F.coalesce("profile_id", "first_profile").alias("profile_id"), F.coalesce(c("company_id").cast("string"), "first_at").alias("company_id"), F.array_union(F.coalesce("companies", empty), F.coalesce("seen", empty)).alias("companies"),
    )
    wrong = rows.where("profile is not null").join(made.select(key, c("profile_id").alias("own")), key).where(~c("profile").eqNullSafe(c("own"))).select("candidate_id", F.lit("linkedin_id_conflict").alias("conflict"))
    return made, _conflicts(candidates, clash, wrong)
