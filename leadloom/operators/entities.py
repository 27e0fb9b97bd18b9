"""Company and person candidates to known or new ones.

The result depends on order: a candidate that is new joins the pool which
later ones are compared with. Only being new changes the pool, and a candidate
is new exactly if no company known before it shares one of its deciding keys:
its provider's id, and its domain or, without a domain, its name. It goes in
rounds. A
candidate that is the first open one under all its deciding keys is new. One
that has a single open candidate before it is new if and only if that one is
not, so chains of such links are followed to their ends by pointer doubling, and
a chain of any length takes a logarithm of joins. What shares a deciding key with
a new one before it is not new. A key of very many candidates is one partial
minimum a task; no group is ever gathered. A candidate with several open ones
before it waits for the next round.
All other decisions follow by equi-joins with one row a key.

For little disk, rows are narrow: keys are made where they are read, an entity
is the ``ord`` of the row it comes from until its id is looked up last, what one
key has decided does not meet the next, and each step is a table whose shuffle
files are gone before the next begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.tables import discard
from ..functions.tables import lean_cut as cut
from ..functions.text import normalize_company_name, normalize_domain, normalize_person_name


def _key(kind: str, *parts: Column) -> Column:
    """Null if a part is null; lengths keep parts apart."""
    return F.concat(F.lit(kind), *[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)])


def _once(**values: Column) -> Column:
    """A struct ``once`` that is computed once a row: a generator's result is not merged into the keys that read it.

    Its names are literals: Spark drops aliases within a select that explodes before it has settled all types.
    """
    return F.explode(F.array(F.named_struct(*[x for name, value in values.items() for x in (F.lit(name), value)]))).alias("once")


def _placed(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds ``ord``, which ascends with ``order``; rows alike in all of it get a number each. To be cut before it is used twice."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id())


def _in_turn(candidates: DataFrame, *texts: str) -> DataFrame:
    """The ``texts`` of candidates as strings, with ``ord``: by time (null first), then by the texts, so that the order is total."""
    at = F.col("discovered_at")
    if isinstance(candidates.schema["discovered_at"].dataType, StringType):
        at = at.cast("timestamp")
    return _placed(candidates.select(at.alias("at"), *[F.col(t).cast("string").alias(t) for t in texts]), F.col("at"), *map(F.col, texts)).drop("at")


def _known(existing: DataFrame, *order: str) -> DataFrame:
    """Known entities with ``ord``, below that of every candidate."""
    return _placed(existing, *[F.col(o).desc() for o in order]).withColumn("ord", -1 - F.col("ord"))


def _first(rows: DataFrame, *value: str) -> DataFrame:
    """The first entity of each key."""
    return rows.where("key is not null").groupBy("key").agg(F.min(F.struct("ord", *value)).alias("top")).select("key", "top.*")


def _two(named: DataFrame) -> DataFrame:
    """(key, one, two): the first and the second entity of each key."""
    one = _first(named).withColumnRenamed("ord", "one")
    two = _first(named.join(one, "key").where("ord > one")).withColumnRenamed("ord", "two")
    return one.join(two, "key", "left")


def _ids(old: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ord, entity) of all known and new rows, and (ord, same): the first row of the same entity."""
    ids = cut(old.select("ord", "entity").unionByName(made.select("ord", "entity")), "entities")
    return ids, cut(ids.join(ids.groupBy("entity").agg(F.min("ord").alias("same")), "entity").select("ord", "same"), "same")


def _knowing(named: DataFrame, same: DataFrame) -> DataFrame:
    """(key, knows) for each entity and each of its names, as :func:`_known_by` looks them up."""
    return named.join(same, "ord").select(_known_by(F.col("key"), F.col("same")).alias("key"), F.lit(True).alias("knows")).distinct()


def _known_by(name: Column, entity: Column) -> Column:
    return F.concat(name, F.lit("|"), entity.cast("string"))


def _look(rows: DataFrame, key: Column, table: DataFrame, **values: str) -> DataFrame:
    """Adds ``values`` (their names, and the columns of a table with one row a key). Rows without a key take one that nothing has, so that they spread."""
    own = F.coalesce(key, F.concat(F.lit("-"), F.col("ord").cast("string")))
    return rows.withColumn("key", own).join(table.select("key", *[F.col(v).alias(n) for n, v in values.items()]), "key", "left").drop("key")


def _before(entity: str) -> Column:
    """An entity, if it came before the candidate."""
    return F.when(F.col(entity) < F.col("ord"), F.col(entity))


def _told(decided: DataFrame, ids: DataFrame, named: str, matched: Column, is_new: Column) -> DataFrame:
    """Decisions (ord, candidate_id, by, reason, conflicts) with the ids of entities: of ``by``, or of the candidate's own row, which has one if it is new."""
    c = F.col
    rows = decided.withColumn("at", F.coalesce("by", "ord")).join(ids.select(c("ord").alias("at"), "entity"), "at", "left")
    status = F.when(matched, "MATCH").when(is_new, "NEW").otherwise("UNRESOLVED")
    return rows.select("candidate_id", status.alias("status"), F.when(matched | is_new, c("entity")).alias(f"{named}_id"), F.when(c("by").isNotNull(), c("entity")).alias(f"matched_{named}_id"), "reason", "conflicts")


def _settled(links: DataFrame) -> DataFrame:
    """(ord, root, odd) for links (ord, to, odd): where each one's way ends, and whether in an odd number of steps.

    Ways double in each round, so a chain of any length takes a logarithm of rounds.
    """
    while True:
        on = links.select(F.col("ord").alias("to"), F.col("to").alias("next"), F.col("odd").alias("more"))
        further = cut(links.join(on, "to", "left").select(
            "ord", F.coalesce("next", "to").alias("to"), (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd"), F.col("next").isNotNull().alias("moved")
        ), "ways")
        discard(links)
        links = further
        if not links.where("moved").limit(1).count():
            return links.select("ord", F.col("to").alias("root"), "odd")


def _new_ones(open_rows: DataFrame) -> DataFrame:
    """``ord`` of the candidates that are new; takes ord, blocks (deciding keys, all of them among gives) and gives (all keys)."""
    keys = open_rows.select("ord", F.explode("gives").alias("key"), "blocks").select("ord", "key", F.array_contains("blocks", F.col("key")).alias("decides"))
    keys = cut(keys, "keys")
    free, found = open_rows.where(F.size("blocks") == 0).select("ord"), []
    while not found or keys.where("decides").limit(1).count():
        # Of each key the first that is open; a key of two leaves its second one candidate before it.
        tops = keys.groupBy("key").agg(F.min("ord").alias("first"), F.count("*").alias("n"))
        behind = F.col("first") < F.col("ord")
        each = cut(
            keys.where("decides").join(tops, "key").groupBy("ord").agg(
                F.min(F.when(behind, F.col("first"))).alias("one"), F.max(F.when(behind, F.col("first"))).alias("other"), F.max(behind & (F.col("n") > 2)).alias("many")
            ), "each",
        )
        ready = each.where("one is null").select("ord")
        if not found:  # What nothing decides is new at once, and gives its keys.
            ready = ready.unionByName(free)
        # Who has one open candidate before it is new if that one is not.
        links = cut(each.where("one = other and not many").select("ord", F.col("one").alias("to"), F.lit(True).alias("odd")), "links")
        ends = cut(_settled(links).join(ready.withColumnRenamed("ord", "root"), "root", "left_semi"), "ends")
        fresh = cut(ready.unionByName(ends.where("not odd").select("ord")), "new")
        found.append(fresh)
        discard(each)
        # What a new one gives is taken from all that come later and are decided by it.
        taken = keys.join(fresh, "ord", "left_semi").groupBy("key").agg(F.min("ord").alias("by"))
        lost = keys.where("decides").join(taken, "key").where(F.col("by") < F.col("ord")).select("ord")
        gone = cut(lost.unionByName(ends.where("odd").select("ord")).unionByName(fresh).distinct(), "gone")
        discard(ends)
        before, keys = keys, cut(keys.join(gone, "ord", "left_anti"), "keys")
        discard(before)
        discard(gone)
    discard(keys)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def first_claims(claims: DataFrame) -> DataFrame:
    """``ord`` of the claims that hold: taken in order, one holds if no earlier one that holds shares a key of its ``keys``."""
    return _new_ones(claims.select("ord", F.col("keys").alias("blocks"), F.col("keys").alias("gives")))


def _made(cand: DataFrame, known: DataFrame, blocks: Column, gives: Column) -> DataFrame:
    """The candidates that are new: of those that meet no ``known`` key, those that :func:`_new_ones` finds by their deciding and all their keys."""
    met = cut(cand.select("ord", F.explode(blocks).alias("key")).join(known, "key", "left_semi").select("ord").distinct(), "met")
    new = _new_ones(cand.join(met, "ord", "left_anti").select("ord", blocks.alias("blocks"), gives.alias("gives")))
    return cand.join(new, "ord", "left_semi")


def resolve_companies(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """One row a candidate: status, company_id, matched_company_id, reason, conflicts.

    Takes candidate_id, provider_id, external_id, name, domain, discovered_at,
    and existing companies as company_id, name, domain, aliases (array) and
    provider_ids (map). Candidates go by discovered_at (null first), then id,
    then provider, external id, name and domain, so ids may repeat; copies go
    one after another. Null or empty names, domains and ids decide
    nothing. Other columns are left aside. Empty tables are allowed.
    """
    c = F.col
    cand = _in_turn(candidates, "candidate_id", "provider_id", "external_id", "name", "domain")
    cand = cand.select("candidate_id", "ord", "provider_id", "external_id", _once(domain=normalize_domain(c("domain")), name=normalize_company_name(c("name"))))
    cand = cut(cand.select("candidate_id", "ord", "provider_id", "external_id", "once.*"), "candidates")
    of = {"p": _key("p", c("provider_id"), c("external_id")), "d": _key("d", c("domain")), "n": _key("n", c("name")), "q": _key("q", c("provider_id"), c("name"))}
    minted = F.sha2(F.concat_ws("|", F.lit("company"), F.coalesce("provider_id", F.lit("")), F.coalesce("external_id", "candidate_id")), 256)

    old = _known(existing.withColumn("entity", c("company_id").cast("string")), "entity", "name", "domain").select(
        "entity", "ord",
        normalize_domain(c("domain")).alias("domain"), F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), normalize_company_name)).alias("names"),
        F.map_entries(F.coalesce("provider_ids", F.create_map().cast("map<string,string>"))).alias("ids"),
    )
    old = cut(old, "known")
    old_p = old.select("ord", "domain", F.explode("ids").alias("i")).select(_key("p", c("i.key"), c("i.value")).alias("key"), "ord", "domain")
    old_d = old.select(_key("d", c("domain")).alias("key"), "ord")
    old_n = old.select("ord", "ids", F.explode("names").alias("name")).where("name is not null")
    old_q = old_n.select("ord", "name", F.explode("ids").alias("i")).select(_key("q", c("i.key"), c("name")).alias("key"), "ord")
    old_n = old_n.select(_key("n", c("name")).alias("key"), "ord")

    known = cut(old_p.select("key").unionByName(old_d.select("key")).unionByName(old_n.select("key")).where("key is not null").distinct(), "known-keys")
    blocks = F.array_compact(F.array(of["p"], F.when(c("domain").isNotNull(), of["d"]).otherwise(of["n"])))
    made = _made(cand, known, blocks, F.array_compact(F.array(of["p"], of["d"], of["n"]))).select("ord", "domain", minted.alias("entity"), *[x.alias(k) for k, x in of.items()])
    made = cut(made, "made")

    ids, same = _ids(old, made)
    p = cut(_first(old_p.unionByName(made.select(c("p").alias("key"), "ord", "domain")), "domain"), "by-p")
    d = cut(_first(old_d.unionByName(made.select(c("d").alias("key"), "ord"))).join(same, "ord"), "by-d")
    q = cut(_first(old_q.unionByName(made.select(c("q").alias("key"), "ord"))), "by-q")
    named = cut(old_n.unionByName(made.select(c("n").alias("key"), "ord").where("key is not null")), "names")
    names, knows = cut(_two(named), "by-n"), cut(_knowing(named, same), "knows")

    seen = _look(cand, of["p"], p, by="ord", held="domain").withColumn("by", _before("by"))
    clash = F.when(c("by").isNotNull() & (c("domain") != c("held")), "domain").otherwise("")
    seen = cut(seen.select("ord", "candidate_id", "provider_id", "name", "domain", "by", clash.alias("conflicts")), "seen")
    discard(cand)
    shown = ("ord", "candidate_id", "by", "reason", "conflicts")
    sure = seen.where("by is not null").withColumn("reason", F.lit("TRUSTED_PROVIDER_IDENTITY"))
    # A domain match names a conflict unless the company knows the candidate's name.
    web = _look(seen.where("by is null and domain is not null").drop("by"), of["d"], d, by="ord", same="same").withColumn("by", _before("by"))
    web = _look(web, F.when(c("by").isNotNull(), _known_by(of["n"], c("same"))), knows, knows="knows")
    web = web.withColumns({"reason": F.when(c("by").isNotNull(), "DOMAIN_MATCH").otherwise("NEW_UNIQUE_DOMAIN"), "conflicts": F.when(c("by").isNotNull() & c("name").isNotNull() & c("knows").isNull(), "name").otherwise("")})
    lone = _look(_look(seen.where("by is null and domain is null").drop("by"), of["q"], q, rival="ord"), of["n"], names, one="one", two="two")
    reason = (
        F.when(_before("rival").isNotNull(), "PROVIDER_IDENTITY_NAME_CONFLICT").when(_before("two").isNotNull(), "AMBIGUOUS_NAME_MULTIPLE_MATCHES")
        .when(_before("one").isNotNull(), "NAME_ONLY_INSUFFICIENT").otherwise("NO_IDENTITY_SIGNALS")
    )
    lone = lone.withColumn("reason", reason).withColumns({
        "by": F.when(c("reason") == "PROVIDER_IDENTITY_NAME_CONFLICT", c("rival")).when(c("reason") == "NAME_ONLY_INSUFFICIENT", c("one")),
        "conflicts": F.when(c("reason") == "PROVIDER_IDENTITY_NAME_CONFLICT", "provider_external_id").when(c("reason") == "AMBIGUOUS_NAME_MULTIPLE_MATCHES", "multiple_name_matches").otherwise(""),
    })
    out = sure.select(*shown).unionByName(web.select(*shown)).unionByName(lone.select(*shown))
    return _told(out, ids, "company", c("reason").isin("TRUSTED_PROVIDER_IDENTITY", "DOMAIN_MATCH"), c("reason").isin("NEW_UNIQUE_DOMAIN", "NO_IDENTITY_SIGNALS"))


def resolve_people(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """One row a candidate: status, person_id, matched_person_id, reason, conflicts.

    Takes candidate_id, provider_id, external_id, name, profile_id,
    company_id and discovered_at, and existing people as person_id, name,
    aliases, profile_id, company_id, companies (array) and provider_ids (map).
    Deciding keys are the provider's id, and the profile or, without one, the
    name within the company (without a company: the name at the provider). A
    match that contradicts the company, profile or name is UNRESOLVED. Order
    (after the external id by name, profile and company), copies, nulls and
    other columns are as for companies.
    """
    c = F.col
    cand = _in_turn(candidates, "candidate_id", "provider_id", "external_id", "name", "profile_id", "company_id")
    cand = cand.select(
        "candidate_id", "ord", "provider_id", "external_id", F.nullif(c("profile_id"), F.lit("")).alias("profile"), F.nullif(c("company_id"), F.lit("")).alias("company"), _once(name=normalize_person_name(c("name")))
    ).select("candidate_id", "ord", "provider_id", "external_id", "profile", "company", "once.*")
    cand = cut(cand, "people")
    minted = F.sha2(F.concat_ws("|", F.lit("person"), F.coalesce("provider_id", F.lit("")), F.coalesce("external_id", "candidate_id")), 256)
    company = c("company").isNotNull()
    at_provider = F.when(company, _key("r", c("provider_id"), c("name"), c("company"))).otherwise(_key("q", c("provider_id"), c("name")))
    of = {"p": _key("p", c("provider_id"), c("external_id")), "l": _key("l", c("profile")), "n": _key("n", c("name"), c("company")), "q": _key("q", c("provider_id"), c("name")), "r": at_provider, "a": _key("a", c("name"))}

    old = _known(existing.withColumn("entity", c("person_id").cast("string")), "entity", "name", "profile_id", "company_id").select(
        "entity", "ord",
        F.nullif(c("profile_id").cast("string"), F.lit("")).alias("profile"), c("company_id").cast("string").alias("company"), F.coalesce(c("companies").cast("array<string>"), F.array().cast("array<string>")).alias("companies"),
        F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), normalize_person_name)).alias("names"),
        F.map_entries(F.coalesce("provider_ids", F.create_map().cast("map<string,string>"))).alias("ids"),
    )
    old = cut(old, "known")
    about = ("profile", "company", "companies")
    by_name = old.select("ord", "ids", "companies", F.explode("names").alias("name")).where("name is not null")
    by_both = by_name.select("ord", "ids", "name", F.explode(F.array_distinct("companies")).alias("at"))
    each_id = F.explode("ids").alias("i")
    keys = {
        "p": old.select("*", each_id).select(_key("p", c("i.key"), c("i.value")).alias("key"), "ord", *about), "l": old.select(_key("l", c("profile")).alias("key"), "ord", *about),
        "n": by_both.select(_key("n", c("name"), c("at")).alias("key"), "ord"), "a": by_name.select(_key("a", c("name")).alias("key"), "ord"),
        "q": by_name.select("*", each_id).select(_key("q", c("i.key"), c("name")).alias("key"), "ord"), "r": by_both.select("*", each_id).select(_key("r", c("i.key"), c("name"), c("at")).alias("key"), "ord"),
    }
    known = keys["p"].select("key").unionByName(keys["l"].select("key")).unionByName(keys["n"].select("key")).unionByName(keys["q"].select("key")).where("key is not null").distinct()
    blocks = F.array_compact(F.array(of["p"], F.when(c("profile").isNotNull(), of["l"]).when(company, of["n"]).otherwise(of["q"])))
    made = _made(cand, cut(known, "known-keys"), blocks, F.array_compact(F.array(*[of[k] for k in "plnq"])))
    made = cut(made.select("ord", "profile", "company", F.array_compact(F.array("company")).alias("companies"), minted.alias("entity"), *[x.alias(k) for k, x in of.items()]), "made")

    ids, same = _ids(old, made)
    both = {k: t.unionByName(made.select(c(k).alias("key"), "ord", *[x for x in about if x in t.columns])).where("key is not null") for k, t in keys.items() if k != "r"}
    # A new person of a company is found by candidates of that company and by those without one.
    both["r"] = keys["r"].unionByName(made.where("company is not null").select(c("r").alias("key"), "ord")).unionByName(both["q"])
    p, d = cut(_first(both["p"], *about), "by-p"), cut(_first(both["l"], *about).join(same, "ord"), "by-l")
    r, a = cut(_first(both["r"]), "by-r"), cut(_first(both["a"]), "by-a")
    names, knows = cut(_two(cut(both["n"], "names")), "by-n"), cut(_knowing(both["a"], same), "knows")

    elsewhere = F.when(company & c("held.company").isNotNull() & ~F.array_contains("held.companies", c("company")), "company")
    listed = lambda *x: F.array_join(F.array_compact(F.array(*x)), ",")
    held = lambda t: t.withColumn("held", F.struct(*about))
    seen = _look(cand, of["p"], held(p), by="ord", held="held").withColumn("by", _before("by"))
    clash = F.when(c("by").isNotNull(), listed(elsewhere, F.when(c("profile") != c("held.profile"), "linkedin_id"))).otherwise("")
    seen = cut(seen.select("ord", "candidate_id", "provider_id", "name", "profile", "company", "by", clash.alias("conflicts")), "seen")
    discard(cand)
    shown = ("ord", "candidate_id", "by", "reason", "conflicts")
    clear = lambda reason: F.when(c("conflicts") != "", "IDENTITY_SIGNAL_CONFLICT").otherwise(reason)
    sure = seen.where("by is not null").withColumn("reason", clear("TRUSTED_PROVIDER_IDENTITY"))
    linked = _look(seen.where("by is null and profile is not null").drop("by"), of["l"], held(d), by="ord", same="same", held="held").withColumn("by", _before("by"))
    linked = _look(linked.withColumn("away", elsewhere).drop("held"), F.when(c("by").isNotNull(), _known_by(of["a"], c("same"))), knows, knows="knows")
    linked = linked.withColumn("conflicts", F.when(c("by").isNotNull(), listed(c("away"), F.when(c("name").isNotNull() & c("knows").isNull(), "name"))).otherwise(""))
    linked = linked.withColumn("reason", F.when(c("by").isNotNull(), clear("LINKEDIN_ID_MATCH")).otherwise("NEW_UNIQUE_LINKEDIN_ID"))
    lone = _look(seen.where("by is null and profile is null").drop("by"), of["r"], r, rival="ord").withColumn("rival", _before("rival"))
    lone = cut(_look(lone.drop("provider_id"), of["n"], names, one="one", two="two").drop("company", "profile"), "lone")
    lone = _look(lone, F.when(c("rival").isNull() & _before("one").isNull(), of["a"]), a, other="ord")
    reason = (
        F.when(c("rival").isNotNull(), "PROVIDER_IDENTITY_CONFLICT").when(_before("two").isNotNull(), "AMBIGUOUS_NAME_MULTIPLE_MATCHES").when(_before("one").isNotNull(), "NAME_AND_COMPANY_INSUFFICIENT")
        .when(_before("other").isNotNull(), "NEW_DIFFERENT_COMPANY_CONTEXT").otherwise("NO_IDENTITY_SIGNALS")
    )
    lone = lone.withColumn("reason", reason).withColumns({
        "by": F.when(c("reason") == "PROVIDER_IDENTITY_CONFLICT", c("rival")).when(c("reason") == "NAME_AND_COMPANY_INSUFFICIENT", c("one")),
        "conflicts": F.when(c("reason") == "PROVIDER_IDENTITY_CONFLICT", "provider_external_id").when(c("reason") == "AMBIGUOUS_NAME_MULTIPLE_MATCHES", "multiple_matches").otherwise(""),
    })
    out = sure.select(*shown).unionByName(linked.select(*shown)).unionByName(lone.select(*shown))
    return _told(out, ids, "person", c("reason").isin("TRUSTED_PROVIDER_IDENTITY", "LINKEDIN_ID_MATCH"), c("reason").startswith("NEW_") | (c("reason") == "NO_IDENTITY_SIGNALS"))
