import datetime as dt
import hashlib
import random

from leadloom.functions.text import normalize_company_name, normalize_domain
from leadloom.operators import entities
from leadloom.operators.entities import first_claims, resolve_companies, resolve_people
from pyspark.sql import functions as F

CAND = "candidate_id string, provider_id string, external_id string, name string, domain string, discovered_at timestamp, company_id string"
OLD = "company_id string, name string, domain string, aliases array<string>, provider_ids map<string,string>"


def one_by_one(cands, old):
    """The rules, candidate after candidate, over a growing pool of (id, names, domain, ids)."""
    pool = [(i, {n, *a} - {None}, d, ids) for i, n, d, a, ids in sorted(old)]
    out = {}
    for cid, prov, ext, name, dom, _ in sorted(cands, key=lambda r: (r[5], r[0])):
        by_id = [p for p in pool if ext is not None and p[3].get(prov) == ext]
        by_dom = [p for p in pool if dom and p[2] == dom]
        named = [p for p in pool if name and name in p[1]]
        rival = [p for p in named if prov in p[3] and p[3][prov] != ext]
        new = False
        if by_id:
            out[cid] = ("MATCH", by_id[0][0], "TRUSTED_PROVIDER_IDENTITY", "domain" if dom and by_id[0][2] and dom != by_id[0][2] else "")
        elif by_dom:
            out[cid] = ("MATCH", by_dom[0][0], "DOMAIN_MATCH", "name" if name and name not in by_dom[0][1] else "")
        elif dom:
            out[cid], new = ("NEW", None, "NEW_UNIQUE_DOMAIN", ""), True
        elif rival:
            out[cid] = ("UNRESOLVED", rival[0][0], "PROVIDER_IDENTITY_NAME_CONFLICT", "provider_external_id")
        elif len(named) > 1:
            out[cid] = ("UNRESOLVED", None, "AMBIGUOUS_NAME_MULTIPLE_MATCHES", "multiple_name_matches")
        elif named:
            out[cid] = ("UNRESOLVED", named[0][0], "NAME_ONLY_INSUFFICIENT", "")
        else:
            out[cid], new = ("NEW", None, "NO_IDENTITY_SIGNALS", ""), True
        if new:
            pool.append((f"new:{cid}", {name} - {None}, dom, {prov: ext}))
    return out


def test_companies_against_one_by_one(spark):
    rnd = random.Random(5)
    pick = lambda p, n, none: None if rnd.random() < none else f"{p}{rnd.randrange(n)}"
    for size in (0, 1, 120):
        old = [(f"c{k}", f"n{rnd.randrange(12)}", pick("d", 25, 0.3), [f"n{rnd.randrange(12)}"] if k % 2 else [], {"p1": f"e{rnd.randrange(30)}"} if k % 3 else {}) for k in range(min(size, 6))]
        cands = [(f"k{k:03d}", f"p{rnd.randrange(3)}", f"e{rnd.randrange(40)}", pick("n", 40, 0.1), pick("d", 25, 0.5), dt.datetime(2024, 1, 1 + rnd.randrange(9))) for k in range(size)]
        got = resolve_companies(spark.createDataFrame([(*c, "extra") for c in cands], CAND), spark.createDataFrame(old, OLD)).collect()
        ids = {r.company_id: f"new:{r.candidate_id}" for r in got if r.status == "NEW"}
        assert len(got) == len(cands)
        assert {r.candidate_id: (r.status, ids.get(r.matched_company_id, r.matched_company_id), r.reason, r.conflicts) for r in got} == one_by_one(cands, old)


def test_a_name_shared_by_all_needs_few_rounds(spark):
    cands = spark.range(3000).select(F.col("id").cast("string").alias("candidate_id"), F.lit("p").alias("provider_id"), F.col("id").cast("string").alias("external_id"), F.lit("Same Co").alias("name"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("timestamp").alias("discovered_at"))
    got = resolve_companies(cands, spark.createDataFrame([], OLD)).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in got} == {"NO_IDENTITY_SIGNALS": 1, "PROVIDER_IDENTITY_NAME_CONFLICT": 2999}


def test_normal_forms_are_used(spark):
    row = spark.range(1).select(normalize_domain(F.lit("HTTPS://www.A.com/x")).alias("d"), normalize_company_name(F.lit("A Inc.")).alias("n")).first()
    assert tuple(row) == ("a.com", "a")


PERSON = "candidate_id string, provider_id string, external_id string, name string, profile_id string, company_id string, discovered_at timestamp"
OLD_PERSON = "person_id string, name string, aliases array<string>, profile_id string, company_id string, companies array<string>, provider_ids map<string,string>"


def people_one_by_one(cands, old):
    pool = [(i, {n, *a}, prof, co, cos, ids) for i, n, a, prof, co, cos, ids in sorted(old)]
    out = {}
    for cid, prov, ext, name, prof, co, _ in sorted(cands, key=lambda r: (r[6], r[0])):
        def away(p):
            return ["company"] if co and p[3] is not None and co not in p[4] else []

        by_id = [p for p in pool if p[5].get(prov) == ext]
        by_prof = [p for p in pool if prof and p[2] == prof]
        named = [p for p in pool if name and name in p[1]]
        here = [p for p in named if co is not None and co in p[4]]
        rival = [p for p in named if prov in p[5] and p[5][prov] != ext and (not co or co in p[4])]
        new = False
        if by_id or by_prof:
            p = (by_id or by_prof)[0]
            clash = away(p) + ((["linkedin_id"] if prof and p[2] and prof != p[2] else []) if by_id else (["name"] if name and name not in p[1] else []))
            out[cid] = ("UNRESOLVED", p[0], "IDENTITY_SIGNAL_CONFLICT", ",".join(clash)) if clash else ("MATCH", p[0], "TRUSTED_PROVIDER_IDENTITY" if by_id else "LINKEDIN_ID_MATCH", "")
        elif prof:
            out[cid], new = ("NEW", None, "NEW_UNIQUE_LINKEDIN_ID", ""), True
        elif rival:
            out[cid] = ("UNRESOLVED", rival[0][0], "PROVIDER_IDENTITY_CONFLICT", "provider_external_id")
        elif len(here) > 1:
            out[cid] = ("UNRESOLVED", None, "AMBIGUOUS_NAME_MULTIPLE_MATCHES", "multiple_matches")
        elif here:
            out[cid] = ("UNRESOLVED", here[0][0], "NAME_AND_COMPANY_INSUFFICIENT", "")
        else:
            out[cid], new = ("NEW", None, "NEW_DIFFERENT_COMPANY_CONTEXT" if named else "NO_IDENTITY_SIGNALS", ""), True
        if new:
            pool.append((f"new:{cid}", {name}, prof, co, [co] if co else [], {prov: ext}))
    return out


def test_people_against_one_by_one(spark):
    rnd = random.Random(9)
    pick = lambda p, n, none: None if rnd.random() < none else f"{p}{rnd.randrange(n)}"
    for size in (0, 150):
        old = [(f"h{k}", f"n{rnd.randrange(8)}", [f"n{rnd.randrange(8)}"] if k % 2 else [], pick("l", 20, 0.4), co := pick("c", 4, 0.2), [co] if co else [], {"p1": f"e{rnd.randrange(30)}"} if k % 3 else {}) for k in range(min(size, 6))]
        cands = [(f"k{k:03d}", f"p{rnd.randrange(3)}", f"e{rnd.randrange(50)}", pick("n", 25, 0.1), pick("l", 25, 0.6), pick("c", 4, 0.2), dt.datetime(2024, 1, 1 + rnd.randrange(9))) for k in range(size)]
        got = resolve_people(spark.createDataFrame(cands, PERSON), spark.createDataFrame(old, OLD_PERSON)).collect()
        ids = {r.person_id: f"new:{r.candidate_id}" for r in got if r.status == "NEW"}
        assert len(got) == len(cands)
        assert {r.candidate_id: (r.status, ids.get(r.matched_person_id, r.matched_person_id), r.reason, r.conflicts) for r in got} == people_one_by_one(cands, old)


def in_turn(claims):
    """Claims one after another: (order, keys that decide, keys given)."""
    given, held = set(), []
    for order, blocks, gives in sorted(claims):
        if not given & set(blocks):
            held.append(order)
            given |= set(gives)
    return held


def test_a_chain_takes_a_logarithm_of_rounds(spark, monkeypatch):
    """100,000 claims, each of which shares a key with the next one only, in their order."""
    rounds = []
    cut = entities.cut
    monkeypatch.setattr(entities, "cut", lambda df, name="part": rounds.append(name) or cut(df, name))
    n = 100_000
    got = first_claims(spark.range(n).select(F.col("id").alias("ord"), F.array(F.concat(F.lit("k"), "id"), F.concat(F.lit("k"), F.col("id") + 1)).alias("keys")))
    row = got.agg(F.count("*"), F.min("ord"), F.max("ord"), F.sum((F.col("ord") % 2).cast("int"))).first()
    assert tuple(row) == (n // 2, 0, n - 2, 0)
    assert rounds.count("ways") < 25 and rounds.count("each") <= 2


def test_claims_of_all_shapes_are_those_of_a_loop(spark):
    """Chains, stars, keys that are only given, and hubs on chains."""
    rnd = random.Random(3)
    for keys in (8,):
        rows = []
        for k in range(60):
            gives = [f"k{x}" for x in rnd.sample(range(keys), rnd.randrange(1, 4))] + [f"chain{k // 2}", f"chain{(k + 1) // 2}x"][: rnd.randrange(3)]
            rows.append((k, rnd.sample(gives, rnd.randrange(len(gives) + 1)), gives))
        rnd.shuffle(rows)
        got = entities._new_ones(spark.createDataFrame(rows, "ord long, blocks array<string>, gives array<string>"))
        assert sorted(r.ord for r in got.collect()) == in_turn(rows)


def test_company_ids_may_repeat_and_times_may_lack_a_zone(spark):
    """Two sightings under one id and time, and two copies of one row."""
    rows = [("k1", "p", "e2", "A", "a.com", "2024-01-02"), ("k1", "p", "e1", "A", "a.com", "2024-01-02"), ("k2", "p", "e3", None, "b.com", "2024-01-01"), ("k2", "p", "e3", None, "b.com", "2024-01-01"), ("k0", "p", "e4", None, "b.com", "2024-01-01 00:00:01")]
    cands = spark.createDataFrame([(*r, "") for r in rows], CAND.replace("timestamp", "string")).withColumn("discovered_at", F.col("discovered_at").cast("timestamp_ntz"))
    got = resolve_companies(cands, spark.createDataFrame([("c1", "B", "c.com", [], {})], OLD)).collect()
    assert sorted((r.candidate_id, r.reason) for r in got) == [("k0", "DOMAIN_MATCH"), ("k1", "DOMAIN_MATCH"), ("k1", "NEW_UNIQUE_DOMAIN"), ("k2", "NEW_UNIQUE_DOMAIN"), ("k2", "TRUSTED_PROVIDER_IDENTITY")]
    mint = hashlib.sha256(b"company|p|e1").hexdigest()
    assert {(r.status, r.company_id) for r in got if r.candidate_id == "k1"} == {("NEW", mint), ("MATCH", mint)}


def test_person_ids_may_repeat_and_times_may_lack_a_zone(spark):
    """Two sightings under one id and time, and two copies of one row."""
    rows = [("k1", "p", "e2", "A", "l1", "c1", "2024-01-02"), ("k1", "p", "e1", "A", "l1", "c1", "2024-01-02"), ("k2", "p", "e3", "B", None, "c2", "2024-01-01"), ("k2", "p", "e3", "B", None, "c2", "2024-01-01"), ("k0", "q", "e4", "B", None, "c2", "2024-01-01 00:00:01")]
    cands = spark.createDataFrame(rows, PERSON.replace("timestamp", "string")).withColumn("discovered_at", F.col("discovered_at").cast("timestamp_ntz"))
    got = resolve_people(cands, spark.createDataFrame([("h1", "C", [], None, None, [], {})], OLD_PERSON)).collect()
    assert sorted((r.candidate_id, r.reason) for r in got) == [("k0", "NAME_AND_COMPANY_INSUFFICIENT"), ("k1", "LINKEDIN_ID_MATCH"), ("k1", "NEW_UNIQUE_LINKEDIN_ID"), ("k2", "NO_IDENTITY_SIGNALS"), ("k2", "TRUSTED_PROVIDER_IDENTITY")]
    mint = hashlib.sha256(b"person|p|e1").hexdigest()
    assert {(r.status, r.person_id) for r in got if r.candidate_id == "k1"} == {("NEW", mint), ("MATCH", mint)}


def test_what_nothing_decides_gives_its_keys(spark):
    """The first claim has no deciding key, the second meets it, the third meets only the second."""
    rows = [(1, [], ["a"]), (2, ["a"], ["a", "b"]), (3, ["b"], ["b"]), (4, [], [])]
    got = entities._new_ones(spark.createDataFrame(rows, "ord long, blocks array<string>, gives array<string>"))
    assert sorted(r.ord for r in got.collect()) == in_turn(rows) == [1, 3, 4]
