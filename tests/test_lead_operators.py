import csv
import datetime as dt
import json
import random
from pathlib import Path

import pytest
from leadloom.functions import tables
from leadloom.operators import entities as N
from leadloom.operators import filters as K
from leadloom.operators import imports as I
from leadloom.operators import matches as H
from leadloom.operators import tuning as U
from leadloom.operators import validation as Z
from leadloom.plans import lead_queries as Q
from leadloom.sources import export as X
from leadloom.sources import records as D
from pyspark.sql import Window
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_numbers_within_groups_equal_a_window(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randrange(20), k) for k in range(800)]
    df = spark.createDataFrame(rows, "g string, x int, id int").repartition(5)
    order = [F.col("x").desc(), F.col("id")]
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert sorted(map(str, tables.numbered(df, ["g"], order, "n").collect())) == sorted(map(str, want.collect()))
    assert tables.numbered(df.limit(0), ["g"], order, "n").count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda key, other: other)

    class Session:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://x:7077"})

    with pytest.raises(ValueError):
        tables.shared_folder(Session)


def plain_company_matches(old, rows):
    """One candidate after another, as they come."""
    state = {i: [d, list(a), dict(p), n] for i, n, d, a, p in old}
    clash = {}
    for at, cid, i, prov, ext, name, domain in sorted(rows, key=lambda r: (r[0], r[1])):
        d, aliases, ids, own = state[i]
        if prov not in ids:
            ids[prov] = ext
        taken = {s[0] for j, s in state.items() if j != i}
        if d is None and domain is not None and domain not in taken:
            state[i][0] = domain
        if name.lower() not in {x.lower() for x in [*aliases, own]}:
            aliases.append(name)
    for _, cid, i, prov, ext, _, domain in rows:
        clash[cid] = sorted(([] if ext == state[i][2][prov] else ["provider_identity_conflict"]) + ([] if domain in (None, state[i][0]) else ["domain_conflict"]))
    return state, clash


def test_company_matches_equal_a_plain_loop(spark):
    """Several companies claim the same domains."""
    for seed in range(4):
        rnd = random.Random(seed)
        old = [(f"c{k}", f"Name {k}", rnd.choice([None, None, f"d{k}.com"]), ["Other"], {"p0": str(k)} if k % 2 else {}) for k in range(8)]
        rows = [(rnd.randrange(30), f"{k:03d}", f"c{rnd.randrange(8)}", f"p{rnd.randrange(3)}", str(rnd.randrange(3)), rnd.choice(["name 1", "New", "NEW", "Other", "x"]), rnd.choice([None, *(f"d{j}.com" for j in range(10))])) for k in range(60)]
        df = spark.createDataFrame([(cid, i, p, e, n, d, dt.datetime(2024, 1, 1 + at)) for at, cid, i, p, e, n, d in rows], "candidate_id string, company_id string, provider_id string, external_id string, name string, domain string, discovered_at timestamp")
        known = spark.createDataFrame(old, "company_id string, name string, domain string, aliases array<string>, provider_ids map<string,string>")
        made, found = H.apply_company_matches(known, df)
        state, clash = plain_company_matches(old, rows)
        assert {r.company_id: [r.domain, r.aliases, r.provider_ids, r.name] for r in made.collect()} == state
        assert {r.candidate_id: r.conflicts for r in found.collect()} == clash


def test_a_chain_of_shared_keys_resolves(spark):
    """Each candidate shares its provider id with the one before and its domain with the next, in order: one round for two of them."""
    rows = [(f"{k:03d}", "p", f"e{(k + 1) // 2}", f"n{k}", f"d{k // 2}.com", dt.datetime(2024, 1, 1, 0, k)) for k in range(24)]
    df = spark.createDataFrame(rows, "candidate_id string, provider_id string, external_id string, name string, domain string, discovered_at timestamp")
    none = spark.createDataFrame([], "company_id string, name string, domain string, aliases array<string>, provider_ids map<string,string>")
    got = {r.candidate_id: r.status for r in N.resolve_companies(df, none).collect()}
    known_e, known_d, want = set(), set(), {}
    for cid, _, e, _, d, _ in rows:
        new = e not in known_e and d not in known_d
        want[cid] = "NEW" if new else "MATCH"
        if new:
            known_e.add(e)
            known_d.add(d)
    assert got == want


def test_exports_are_read_back(spark, tmp_path):
    leads = Q._exported(spark, SF)
    rows = {str(r.lead_id): r for r in X.export_values(leads.select(*X.COLUMNS)).collect()}
    X.write_csv(leads, f"file://{tmp_path}/full")
    read = [r for part in sorted(Path(f"{tmp_path}/full").glob("part-*.csv")) for r in csv.DictReader(part.open(newline=""))]
    assert len(read) == len(rows) and list(read[0]) == list(X.COLUMNS)
    assert all(r == rows[r["lead_id"]].asDict() for r in read)
    places = [(r["icp_id"], int(r["rank"])) for r in read]
    assert places == sorted(places)
    for layout, third in (("hubspot", "Company name"), ("salesforce", "Account Name")):
        X.write_crm_csv(leads, f"file://{tmp_path}/{layout}", layout, "Own - ")
        made = [r for part in sorted(Path(f"{tmp_path}/{layout}").glob("part-*.csv")) for r in csv.DictReader(part.open(newline=""))]
        assert len(made) == len(rows) and len(made[0]) == 12 and {third, "Own - Rank", "Own - Full Name (unsplit, authoritative)"} <= set(made[0]) and {r["Email"] for r in made} == {"a@b.c", "UNKNOWN"}
    X.write_json(leads, f"file://{tmp_path}/json")
    told = [json.loads(x) for part in sorted(Path(f"{tmp_path}/json/leads").glob("part-*")) for x in part.open()]
    assert [(r["icp_id"], r["rank"]) for r in told] == places and told[0]["identity"]["person_title"] is None and told[0]["batch_id"] is None
    heads = [json.loads(x) for part in Path(f"{tmp_path}/json/metadata").glob("part-*") for x in part.open()]
    assert sum(h["lead_count"] for h in heads) == len(rows)


def test_snapshots_are_written_once_and_read_as_of_a_day(spark, tmp_path, monkeypatch):
    """The same day twice, a run that dies before its commit, one that dies half way through its profiles, and days between."""
    path = f"file://{tmp_path}/snap"
    kind = "icp_id string, lead_id int, rank int"
    day = lambda *rows: spark.createDataFrame(rows, kind)
    read = lambda as_of: sorted((r.icp_id or "", r.lead_id, r["rank"], r.snapshot_date) for r in X.read_snapshot(spark, path, as_of).collect())
    X.append_snapshot(day(("01", 1, 1), ("01", 2, 2), (None, 3, 1)), path, "2024-02-01")
    first = [("", 3, 1, "2024-02-01"), ("01", 1, 1, "2024-02-01"), ("01", 2, 2, "2024-02-01")]
    assert read("2024-02-01") == read("2024-02-09") == first
    X.append_snapshot(day(("01", 1, 1), ("01", 2, 2), (None, 3, 1)), path, "2024-02-01")
    X.append_snapshot(day(("01", 9, 9)), path, "2024-02-01")
    assert read("2024-02-01") == first and X.snapshots(spark, path).count() == 2
    # Rows without a commit are no snapshot.
    with monkeypatch.context() as m:
        m.setattr(X, "COMMIT_FOLDER", "no\0where")
        with pytest.raises(Exception):  # noqa: B017
            X.append_snapshot(day(("01", 5, 1), ("1", 6, 1)), path, "2024-02-05")
    assert read("2024-02-06") == first
    X.append_snapshot(day(("01", 7, 1), ("1", 8, 1)), path, "2024-02-05")
    assert read("2024-02-04") == first
    assert read("2024-02-06") == [("", 3, 1, "2024-02-01"), ("01", 7, 1, "2024-02-05"), ("1", 8, 1, "2024-02-05")]
    with pytest.raises(ValueError, match="no snapshot"):
        X.read_snapshot(spark, path, "2023-01-01")


def test_review_table_quotes_what_needs_it(spark, tmp_path):
    rows = [('Acme, "Tea"', None, 1.5, 1), ("two\nlines", "", None, 2)]
    df = spark.createDataFrame(rows, "company_name string, company_domain string, final_score double, rank int").withColumn("lead_id", F.col("rank"))
    for name in X.REVIEW.values():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    X.write_review_csv(df.coalesce(1), f"file://{tmp_path}/review")
    read = [r for part in sorted(Path(f"{tmp_path}/review").glob("part-*.csv")) for r in csv.DictReader(part.open(newline=""))]
    assert [(r["Company"], r["Company Domain"], r["Final Score"]) for r in read] == [('Acme, "Tea"', "", "1.5"), ("two\nlines", "", "")]


def test_stored_tables_have_declared_columns(spark, tmp_path):
    spark.createDataFrame([("l", "c")], "id string, company_id string").write.parquet(f"{tmp_path}/canonical_leads")
    assert D.read_table(spark, str(tmp_path), "canonical_leads").collect()[0].asDict() == {"id": "l", "company_id": "c", "person_id": None}


def test_provenance_is_written_and_read(spark):
    shape = ", ".join(I.ATTRIBUTES.split(", "))
    row = dict.fromkeys([x.rsplit(" ", 1)[0] for x in I.ATTRIBUTES.split(", ")])
    row |= {"industry": "Tea", "industry_match_branch": "naics", "industry_match_terms": ["Tea"], "industry_match_branch_total_results": 3, "keyword_match_terms": ["tea", "x"], "keyword_match_term_sources": ["industry", "site"]}
    struct = f"struct<{', '.join(':'.join(x.rsplit(' ', 1)) for x in shape.split(', '))}>"
    df = spark.createDataFrame([("1", "p", "e", "Acme", None, None, row)], f"candidate_id string, provider_id string, external_id string, name string, domain string, discovered_at timestamp, attributes {struct}")
    made = I.company_evidence(df, spark.createDataFrame([("1", "c")], "candidate_id string, company_id string"))
    assert {r.field: r.value_json for r in made.collect()} == {"company_identity": '"Acme"', "industry": '"Tea"'}
    p = made.where("field = 'industry'").select(I.read_provenance(F.col("evidence_text")).alias("p")).first().p
    assert p.industry_match.icp_terms == ["Tea"] and p.industry_match.branch_total_results == 3 and p.keyword_match.term_sources == ["industry", "site"] and p.company_type_match is None
    long = I.industry_provenance(F.struct(*[F.lit(row[x.rsplit(" ", 1)[0]]).cast(x.rsplit(" ", 1)[1]).alias(x.rsplit(" ", 1)[0]) if not isinstance(row[x.rsplit(" ", 1)[0]], list) else F.array_repeat(F.lit("t" * 50), 99).alias(x.rsplit(" ", 1)[0]) for x in I.ATTRIBUTES.split(", ")]))
    assert len(spark.range(1).select(long.alias("t")).first().t) == I.TEXT_CHARS
    odd = spark.createDataFrame([("[1]",), ("no",), (None,), ('{"industry_match": 5}',)], "t string").select(I.read_provenance(F.col("t")).alias("p")).collect()
    assert odd[0].p is odd[1].p is odd[2].p is None


def test_empty_evidence_holds_whatever_is_constrained(spark):
    from leadloom.operators import evidence as E
    from leadloom.plans import adapters as A

    rows = A.facts(spark, SF).withColumn("value", F.col("value_json")).limit(0)
    asked = spark.createDataFrame([("icp0", "x", None), ("icp0", "x", "q1"), ("icp2", "x", None), ("none", "x", None)], "icp_id string, company_id string, person_id string")
    got = {(r.icp_id, r.person_id): (r.overall, r.reasons) for r in Z.validate(asked, A.evidence_profiles(spark), rows, E.field_status(rows)).collect()}
    assert got[("icp2", None)] == ("HOLD", ["INDUSTRY_UNKNOWN"]) and ("none", None) not in got
    assert got[("icp0", None)] == ("HOLD", ["EMPLOYEE_COUNT_UNKNOWN", "GEOGRAPHY_UNKNOWN", "INDUSTRY_UNKNOWN", "INSUFFICIENT_EVIDENCE"])
    assert got[("icp0", "q1")][1] == ["EMPLOYEE_COUNT_UNKNOWN", "GEOGRAPHY_UNKNOWN", "INDUSTRY_UNKNOWN", "TITLE_UNKNOWN", "INSUFFICIENT_EVIDENCE"]


def test_a_null_text_asks_for_nothing(spark):
    row = K.extracted(spark.createDataFrame([(None,), ("",)], "t string"), "t").collect()
    assert row[0].min_employees is None and row[1].exclusions == [] and row[1].industry == [] and row[0].unmatched == []


def test_routes_prefer_promotion(spark):
    df = spark.createDataFrame([(1, 1, ["down"]), (1, 2, None), (1, 3, ["down", "up"]), (1, 4, [None])], "g int, at int, signals array<string>")
    got = [r["at"] for r in U.route_providers(df, ["up"], ["down"], ["g"], "at").orderBy("route").collect()]
    assert got == [3, 2, 4, 1]


def test_rules_cite_the_branch_that_decided(spark):
    """Fields, corroboration over a conflict, descriptions in place of what cannot be proved, titles and exclusions."""
    from leadloom.operators import evidence as E
    from leadloom.operators import validation as Z

    branch = '{"industry_match": {"taxonomy_field": "naics", "icp_terms": ["skincare"], "match_scope": "single_category", "branch_total_results": 2}}'
    word = lambda t: f'{{"keyword_match": {{"terms": ["{t}"], "term_sources": ["industry"]}}}}'
    facts = [
        ("a", "industry", '"Retail"', branch), ("a", "industry", '"Retail"', branch), ("a", "description", '"Skincare for beauty"', None), ("a", "description", '""', None),
        ("b", "industry", '"Skin"', word("skincare")), ("b", "industry", '"Bath"', word("Beauty")), ("b", "industry", '"Other"', word("toys")), ("b", "description", '"skincare beauty"', None),
        ("c", "industry", '"Skincare"', None), ("c", "industry", '"skincare"', None), ("c", "employee_count", "12", None), ("c", "employee_count", "12", None), ("c", "employee_range", '"11-50"', None), ("c", "employee_range", '"11-50"', None),
        ("d", "industry", '"Retail"', branch), ("d", "industry", '"Retail"', branch), ("d", "description", '"A DTC Brand"', None), ("d", "domain", '"d.com"', None), ("d", "domain", '"d.com"', None),
    ]
    people = [("p", "company_association", '"c"'), ("p", "company_association", '"c"'), ("p", "current_title", '"CEO"'), ("p", "current_title", '"CEO"'), ("q", "company_association", '"z"'), ("q", "company_association", '"z"'), ("q", "current_title", '"CEO"'), ("q", "current_title", '"CEO"')]
    kind = "entity_type string, entity_id string, field string, value_json string, evidence_text string, id long"
    rows = [("COMPANY", e, f, v, t, k) for k, (e, f, v, t) in enumerate(facts)] + [("PERSON", e, f, v, None, 100 + k) for k, (e, f, v) in enumerate(people)]
    df = spark.createDataFrame(rows, kind).selectExpr("*", "lower(value_json) AS key", "value_json AS value", "'p1' AS provider", "'UNKNOWN' AS confidence", "timestamp '2024-01-01' AS retrieved_at")
    icps = spark.createDataFrame(
        [("i", ["Skincare", "Beauty"], [], ["US"], [], 1, 99, ["CEO"], ["DTC brand"], ["toys"])],
        "icp_id string, industries array<string>, combinations array<string>, country_codes array<string>, other_places array<string>, min_employees int, max_employees int, titles array<string>, company_types array<string>, excluded array<string>",
    )
    asked = spark.createDataFrame([("i", "a", None), ("i", "b", None), ("i", "c", "p"), ("i", "c", "q"), ("i", "d", None)], "icp_id string, company_id string, person_id string")
    got = {}
    for r in Z.cited_rows(asked, icps, df, E.field_status(df)).collect():
        got.setdefault((r.company_id, r.person_id), {}).setdefault(r.rule, []).append(r.evidence_id)
    got = {k: {rule: sorted(ids) for rule, ids in v.items()} for k, v in got.items()}
    assert got[("a", None)] == {"industry": [2], "exclusions": [2]}
    assert got[("b", None)] == {"industry": [4, 5], "exclusions": [4, 5]}
    company = {"industry": [8, 9], "employee_range": [10, 11]}
    assert got[("c", "p")] == company | {"allowed_titles": [102, 103], "exclusions": [8, 9, 102, 103]}
    assert got[("c", "q")] == company | {"exclusions": [8, 9]}
    assert got[("d", None)] == {"company_type": [16], "exclusions": [16, 17, 18]}


def test_stored_answers_are_read_by_their_form(spark):
    """Wrong types, missing parts, rows without a name, answers that are no JSON and forms nobody knows."""
    from leadloom.operators import search as S

    rows = [
        (1, "people_search", '{"items": [{"id": 7, "name": "Ann", "current_positions": []}, {"id": null, "name": "x", "public_identifier": "x"}, "text", {"id": "8", "name": "Bo", "public_profile_url": "https://www.linkedin.com/in/Bo/", "public_identifier": "no"}]}'),
        (2, "people_search", '{"items": "none"}'), (3, "person_match", '{"person": null}'), (4, "person_match", '{"person": {"title": "", "email": "a@b.c"}}'),
        (5, "registry", '{"results": {"bindings": [{"countryLabel": {}}, {"countryLabel": {"value": "France"}, "inception": {"value": "c. 1999"}}, {"countryLabel": {"value": "Spain"}, "inception": {"value": "2010-01-01T00:00:00Z"}}]}}'),
        (6, "filings", '{"addresses": null, "sicDescription": "Tea"}'), (7, "email_check", '{"is_role_email": {"value": "true"}, "is_catchall_email": {"value": false}}'),
        (8, "phone_check", '{"valid": "yes", "type": 3, "carrier": "Tel"}'), (9, "filings", "{broken"), (10, "nobody", '{"name": "x"}'), (11, None, None), (12, "filings", None),
    ]
    got = S.vendor_facts(spark.createDataFrame([(k, "p", f, b) for k, f, b in rows], "entity_id long, provider string, form string, body string")).collect()
    assert sorted((r.entity_id, r.external_id, r.field, r.value) for r in got) == [
        (1, "8", "linkedin_id", "in/bo"), (1, "8", "linkedin_url", "https://www.linkedin.com/in/bo"), (4, "4", "email", "a@b.c"), (5, "5", "country", "France"), (5, "5", "founded_year", "2010"),
        (6, "6", "industry", "Tea"), (7, "7", "email_is_catchall", "false"), (8, "8", "phone_carrier", "Tel"),
    ]
