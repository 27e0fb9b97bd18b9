"""Discovery rounds and leads: unions, repeats, caps and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import before_target


def union_sightings(sources: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """All sources' rows; of rows with the same key the first stays."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__first"))
    return first.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest])


def merged_sightings(sources: list[DataFrame], keys: list[str], order: str, lists: list[str]) -> DataFrame:
    """All sources' rows, one a key: each plain column by the first row that states it, each term list by all rows, a term where it first stands.

    A key of very many sightings is one row a task for the plain columns and
    one a task for each of its different terms: lists are never gathered.
    """
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s, allowMissingColumns=True)
    plain = [c for c in rows.columns if c not in (*keys, *lists)]
    made = rows.groupBy(*keys).agg(*[F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in plain])
    for x in lists:
        terms = rows.select(*keys, order, F.posexplode(x).alias("__at", "__term")).groupBy(*keys, "__term").agg(F.min(F.struct(order, "__at")).alias("__first"))
        own = terms.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__first", "__term"))), lambda t: t["__term"]).alias(x))
        made = made.join(own, keys, "left")
    return made.select(*keys, *[c for c in rows.columns if c not in keys])


def deduplicate(requests: DataFrame, existing: DataFrame, people: DataFrame, order: str) -> DataFrame:
    """Adds decision and reason: matches an existing (company_id, person_id) pair or an earlier one of this batch, else NEW; null persons equal each other.

    Without a company, or with a person who is not known to be at it,
    UNRESOLVED. ``people`` has person_id and companies (array). Pairs are
    found by one minimum each, so a hot pair is one row a task.
    """
    c = F.col
    pair = ["company_id", "person_id"]
    known = existing.select(*[c(k).alias(f"__{k}") for k in pair]).distinct().withColumn("__known", F.lit(True))
    at = people.select(c("person_id").alias("__p"), c("companies").alias("__at"))
    usable = requests.where("company_id is not null").join(at, c("person_id") == c("__p"), "left")
    fine = c("person_id").isNull() | F.coalesce(F.array_contains("__at", c("company_id")), F.lit(False))
    good, stray = usable.where(fine).select(*requests.columns), usable.where(~fine).select(*requests.columns)
    first = good.groupBy(*pair).agg(F.min(order).alias("__first")).select(*[c(k).alias(f"__f_{k}") for k in pair], "__first")
    same = lambda p: c("company_id").eqNullSafe(c(f"{p}company_id")) & c("person_id").eqNullSafe(c(f"{p}person_id"))
    rows = good.join(known, same("__"), "left").join(first, same("__f_"))
    met = c("__known") | (c(order) > c("__first"))
    told = lambda df, decision, reason: df.select(*requests.columns, decision.alias("decision"), reason.alias("reason"))
    held = F.coalesce(met, F.lit(False))
    return (
        told(rows, F.when(held, "MATCHED_EXISTING_LEAD").otherwise("NEW_LEAD"), F.concat(F.when(held, "EXACT_COMPANY_").otherwise("NEW_COMPANY_"), F.when(c("person_id").isNull(), "ONLY").otherwise("PERSON"), F.when(held, "_MATCH").when(c("person_id").isNull(), "").otherwise("_PAIR")))
        .unionByName(told(stray, F.lit("UNRESOLVED"), F.lit("PERSON_NOT_CURRENTLY_ASSOCIATED_WITH_COMPANY")))
        .unionByName(told(requests.where("company_id is null"), F.lit("UNRESOLVED"), F.lit("COMPANY_IDENTITY_UNRESOLVED")))
    )


def first_per_batch(rows: DataFrame, batch: str, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each batch, in order: the cap of a round."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(batch).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def until_target(rows: DataFrame, batch: str, order: list[str], accepted: str, target: int) -> DataFrame:
    """Rows that are processed before a batch has ``target`` accepted ones (null: not accepted); a batch of any size spreads over tasks."""
    return before_target(rows, [batch], [F.col(o) for o in order], F.col(accepted), target)
