"""What approved recommendations change: their status, the configuration in force, previews and routes; and short term lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..functions.tables import cut, numbered
from .ranking import latest, tier_index


def recommendation_status(recommendations: DataFrame, approvals: DataFrame, applications: DataFrame) -> DataFrame:
    """Adds status: the last application event, else the last approval, else PENDING. The logs have fingerprint, event, at and id."""
    last = lambda log, name: latest(log.select("fingerprint", "event", "at", "id"), ["fingerprint"], "at", "id").select("fingerprint", F.col("event").alias(name))
    rows = recommendations.join(last(approvals, "__approved"), "fingerprint", "left").join(last(applications, "__applied"), "fingerprint", "left")
    return rows.withColumn("status", F.coalesce("__applied", "__approved", F.lit("PENDING"))).drop("__approved", "__applied")


# The kinds of recommendations that a configuration lists.
KINDS = ("RANKING_TIE_BREAK_NUDGE", "SOFT_PREFERENCE_WEIGHT_HINT", "PROVIDER_PRIORITY_HINT", "DEEPER_VERIFICATION_HINT")


def _last(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys, "fingerprint").agg(F.max(F.struct("at", "id", "kind", "event")).alias("top"))


def configuration_state(versions: DataFrame, events: DataFrame) -> DataFrame:
    """What is in force, as rows: icp_id, icp_version, kind, fingerprint, effect.

    SHARED rows, without a version, are in force for every version but those
    that have a REMOVED row of that kind and fingerprint; ADDED rows are in
    force for their version. ``events`` has fingerprint, kind, event, icp_id,
    icp_version, is_global, at and id. In scope are a version's own events
    and the global ones; of a fingerprint's events in scope the last decides,
    and only APPLIED counts. So a version has rows only for fingerprints on
    which it departs, and a change of a global one is a change of one row.
    """
    c, scope = F.col, ["icp_id", "icp_version"]
    log = events.select("fingerprint", "kind", "event", *scope, F.coalesce("is_global", F.lit(False)).alias("is_global"), "at", "id")
    shared = _last(log.where("is_global"), []).withColumnRenamed("top", "all")
    own = _last(log.where("not is_global"), scope).join(versions.select(*scope).distinct(), scope, "left_semi").join(shared, "fingerprint", "left")
    # Where the version's own event is the later one, it decides.
    own = own.where(c("all").isNull() | (c("top") > c("all")))
    was, now = F.coalesce(c("all.event") == "APPLIED", F.lit(False)), c("top.event") == "APPLIED"
    moved = c("top.kind") != c("all.kind")
    row = lambda effect, kind: F.struct(kind.alias("kind"), F.lit(effect).alias("effect"))
    changes = F.array_compact(F.array(F.when(was & (~now | moved), row("REMOVED", c("all.kind"))), F.when(now & (~was | moved), row("ADDED", c("top.kind")))))
    departs = own.select(*scope, "fingerprint", F.explode(changes).alias("x")).select(*scope, "x.kind", "fingerprint", "x.effect")
    none = [F.lit(None).cast(departs.schema[k].dataType).alias(k) for k in scope]
    return shared.where(c("all.event") == "APPLIED").select(*none, "all.kind", "fingerprint", F.lit("SHARED").alias("effect")).unionByName(departs)


#: Fingerprints that go together when shared ones are listed for versions.
PAGE = 1000


def effective_configuration(versions: DataFrame, events: DataFrame) -> DataFrame:
    """For each of ``versions`` (icp_id, icp_version): the fingerprints in force, as one sorted list a kind, and whether all are empty.

    The lists of :func:`configuration_state`, spelled out. Shared fingerprints
    go in pages of PAGE, which versions meet by the page's number.
    """
    c, scope = F.col, ["icp_id", "icp_version"]
    state = cut(configuration_state(versions, events), "state")
    asked = cut(versions.select(*scope).distinct(), "versions")
    pages = numbered(state.where("effect = 'SHARED'").select("kind", "fingerprint"), [], [c("kind"), c("fingerprint")], "k")
    pages = cut(pages.groupBy(F.floor((c("k") - 1) / PAGE).alias("page")).agg(F.collect_list(F.struct("kind", "fingerprint")).alias("rows")), "pages")
    many = pages.count()
    met = asked.select(*scope, F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("page")).join(pages, "page") if many else None
    rows = state.where("effect = 'ADDED'").select(*scope, "kind", "fingerprint")
    if met is not None:
        gone = state.where("effect = 'REMOVED'").select(*scope, "kind", "fingerprint")
        rows = rows.unionByName(met.select(*scope, F.inline("rows")).join(gone, [*scope, "kind", "fingerprint"], "left_anti"))
    lists = [F.array_sort(F.collect_list(F.when(c("kind") == k, c("fingerprint")))).alias(k.lower()) for k in KINDS]
    made = asked.join(rows.groupBy(*scope).agg(*lists), scope, "left")
    empty = F.array().cast("array<string>")
    made = made.select(*scope, *[F.coalesce(k.lower(), empty).alias(k.lower()) for k in KINDS])
    return made.withColumn("is_default", sum((F.size(k.lower()) for k in KINDS[1:]), F.size(KINDS[0].lower())) == 0)


def preview_ranking(ranking: DataFrame, signals: DataFrame, nudges: DataFrame) -> DataFrame:
    """Adds adjustment and new_position: a lead's nudges move it inside its tier only; ties keep their order.

    ``ranking`` has lead_id, icp_id, tier and position; ``signals`` lead_id
    and signal; ``nudges`` signal and magnitude. A repeated (lead, signal)
    pair counts once.
    """
    moved = signals.select("lead_id", "signal").distinct().join(nudges.groupBy("signal").agg(F.sum("magnitude").alias("magnitude")), "signal").groupBy("lead_id").agg(F.sum("magnitude").alias("adjustment"))
    rows = ranking.join(moved, "lead_id", "left").na.fill(0.0, ["adjustment"])
    return numbered(rows, ["icp_id"], [tier_index(F.col("tier")), F.col("adjustment").desc(), F.col("position")], "new_position")


def version_icps(new: DataFrame, existing: DataFrame, created: str, tie: str) -> DataFrame:
    """Adds version: one more than the greatest of the name (case does not count), in order of creation."""
    key = F.lower(F.col("name"))
    top = existing.groupBy(key.alias("__k")).agg(F.max("version").alias("__top"))
    rows = numbered(new.withColumn("__k", key), ["__k"], [F.col(created), F.col(tie)], "__nth").join(top, "__k", "left")
    return rows.select(*new.columns, (F.col("__nth") + F.coalesce("__top", F.lit(0))).cast("int").alias("version"))


def route_providers(providers: DataFrame, promoted: list[str], demoted: list[str], group: list[str], position: str) -> DataFrame:
    """Adds route (1..n in a group): providers of a promoted signal first, whatever else they have; of a demoted one last; else in order.

    A group is the providers of one profile and capability: a handful of rows.
    """
    signals = F.coalesce("signals", F.array().cast("array<string>"))
    has = lambda names: F.coalesce(F.arrays_overlap(F.array_compact(signals), F.array(*map(F.lit, names)).cast("array<string>")), F.lit(False))
    weight = F.when(has(promoted), -1).when(has(demoted), 1).otherwise(0)
    return providers.withColumn("route", F.row_number().over(Window.partitionBy(*group).orderBy(weight, position)))


def clean_terms(terms: Column, most: int | None = None) -> Column:
    """Cleaned terms without blanks; of those that differ by case only the first stays; at most the first ``most``."""
    tidy = F.filter(F.transform(terms, clean_text), lambda t: t != "")
    fold = F.aggregate(tidy, F.array().cast("array<string>"), lambda kept, t: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(t)), kept).otherwise(F.array_append(kept, t)))
    return F.slice(fold, 1, most) if most else fold


def prioritized_terms(terms: Column, users: Column, combinations: Column, most: int = 12) -> Column:
    """At most ``most`` terms, in their order: a user's terms are kept first, then combinations, then others."""
    kept = clean_terms(terms)
    rank = lambda t: F.when(F.exists(users, lambda u: F.lower(u) == F.lower(t)), 0).when(F.exists(combinations, lambda u: F.lower(u) == F.lower(t)), 1).otherwise(2)
    ranked = F.transform(kept, lambda t, i: F.struct(rank(t).alias("rank"), i.alias("at"), t.alias("term")))
    chosen = F.array_sort(F.transform(F.slice(F.array_sort(ranked), 1, most), lambda r: F.struct(r["at"].alias("at"), r["term"].alias("term"))))
    return F.transform(chosen, lambda r: r["term"])


def term_origins(users: Column, proposed: Column) -> Column:
    """Map of every term to user or ai; a user's claim wins."""
    mine, other = clean_terms(users), clean_terms(proposed)
    rest = F.filter(other, lambda t: ~F.exists(mine, lambda u: F.lower(u) == F.lower(t)))
    tag = lambda a, name: F.transform(a, lambda t: F.struct(t.alias("term"), F.lit(name).alias("origin")))
    return F.map_from_entries(F.concat(tag(mine, "user"), tag(rest, "ai")))


def verification_fields(results: Column, most: int = 2) -> Column:
    """The first rules on HOLD, in rule order."""
    return F.slice(F.transform(F.filter(results, lambda r: r["status"] == "HOLD"), lambda r: r["rule"]), 1, most)
