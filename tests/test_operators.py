import datetime as dt

from leadloom.functions import text as T
from leadloom.operators import evidence as E
from leadloom.operators import feedback as B
from leadloom.operators import leads as L
from leadloom.operators import ranking as R
from leadloom.operators import rules as P
from leadloom.sources import export as S
from leadloom.streaming.ingest import create_store, ingest_batch, read_store
from pyspark.sql import functions as F


def values(spark, rows, f):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, x string")
    return [r.y for r in df.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_text_functions(spark):
    assert values(spark, ["https://www.ABC.com/x?y", "abc.com.", " ", None], T.normalize_domain) == ["abc.com", "abc.com", None, None]
    assert values(spark, ["ABC, Inc.", "Foo-inc", "Co Ltd", "A  B Co. LLC"], T.normalize_company_name) == ["abc", "foo-inc", None, "a b"]
    assert values(spark, ["U.S.A.", "deutschland", "EMEA", None], T.country_code) == ["US", "DE", None, None]
    assert values(spark, ["VP of Sales", "Sales, Vice President"], T.title_key) == ["president sales vice"] * 2
    assert values(spark, ["51-200", "10001+", "9-3", "x"], lambda c: F.to_json(T.employee_bucket(c))) == ['{"low":51,"high":200}', '{"low":10001}', None, None]
    assert values(spark, ["Ann Lee Roe", "Roe", "A B Jr."], lambda c: F.concat_ws("|", T.split_person_name(c)["first"], T.split_person_name(c)["last"])) == ["Ann Lee|Roe", "|Roe", "A|B Jr."]


def test_field_status(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("COMPANY", "a", "industry", k, c, p, t, str(n)) for n, (k, c, p) in enumerate([("x", "LOW", "p"), ("y", "LOW", "q")])]
    rows += [("COMPANY", "b", "industry", "x", "LOW", "p", t, "3"), ("COMPANY", "b", "industry", "x", "LOW", "p", t, "4"), ("COMPANY", "c", "industry", "x", "UNKNOWN", "trusted", t, "5"), ("COMPANY", "d", "domain", "x", "HIGH", "p", t, "6"), ("COMPANY", "e", "domain", "x", "LOW", "trusted", t, "7")]
    df = spark.createDataFrame(rows, "entity_type string, entity_id string, field string, key string, confidence string, provider string, retrieved_at timestamp, id string")
    got = {r.entity_id: r.status for r in E.field_status(df, ("trusted",)).collect()}
    assert got == {"a": "CONFLICT", "b": "SUPPORTED", "c": "SUPPORTED_STRUCTURED", "d": "SUPPORTED", "e": "INSUFFICIENT"}
    summary = {r.entity_id: r for r in E.entity_summary(E.field_status(df), E.COMPANY_CRITICAL).collect()}
    assert summary["a"].conflicting == ["industry"] and len(summary["a"].missing) == 8


def test_rules_hold_on_unknown_and_fail_first(spark):
    icp = spark.createDataFrame([("i", ["Skincare"], ["US"], [], 10, 200, ["VP Marketing"], [], ["casino"])], "icp_id string, industries array<string>, country_codes array<string>, other_places array<string>, min_employees int, max_employees int, titles array<string>, company_types array<string>, excluded array<string>")
    rows = [("i", "Acme", None, "skincare", "USA", 50, None, "Vice President of Marketing", None), ("i", "Bolt", None, None, "USA", None, "51-200", "VP Marketing", None), ("i", "Casino X", None, "skincare", "FR", 5000, None, None, None)]
    cands = spark.createDataFrame(rows, "icp_id string, company_name string, domain string, industry string, country string, employee_count int, employee_range string, title string, company_type string")
    got = {r.company_name: (r.overall, r.reasons) for r in P.evaluate(cands, icp).collect()}
    assert got["Acme"] == ("PASS", []) and got["Bolt"] == ("HOLD", ["INDUSTRY_UNKNOWN"])
    assert got["Casino X"] == ("FAIL", ["EMPLOYEE_TOO_LARGE", "WRONG_GEOGRAPHY", "EXPLICIT_EXCLUSION", "TITLE_UNKNOWN"])


def test_ranking_fail_is_last_and_ties_go_by_id(spark):
    kind = "lead_id string, icp_id string, hard_rule_result string, batch_outcome string, human_review_decision string, adversarial_result string, qualification_decision string, s double"
    rows = [("a", "i", "FAIL", None, "ACCEPT", None, "GOOD_FIT", 100.0), ("c", "i", "PASS", None, None, "SURVIVES", "GOOD_FIT", 5.0), ("b", "i", "PASS", None, None, None, "GOOD_FIT", 5.0), ("d", "i", "PASS", None, None, "WEAKENED", "GOOD_FIT", 99.0)]
    got = R.rank_leads(spark.createDataFrame(rows, kind), ["s"]).orderBy("position").collect()
    assert [(r.lead_id, r.tier) for r in got] == [("b", "QUALIFIED_STRONG"), ("c", "QUALIFIED_STRONG"), ("d", "QUALIFIED_WEAK"), ("a", "HARD_FAILED")]


def test_feedback_and_leads(spark):
    rows = [("GOOD_FIT", ["m:D"])] * 2 + [("NOT_FIT", ["m:D"]), ("HOLD", ["m:E"])]
    got = {r.signal: r.rate for r in B.signal_correlation(spark.createDataFrame(rows, "decision string, signals array<string>")).collect()}
    assert abs(got["m:D"] - 2 / 3) < 1e-9 and got["m:E"] is None
    req = spark.createDataFrame([(1, "c", None), (2, "c", None), (3, "d", "p"), (4, None, "p")], "seq int, company_id string, person_id string")
    have = spark.createDataFrame([("d", "p")], "company_id string, person_id string")
    people = spark.createDataFrame([("p", ["d"])], "person_id string, companies array<string>")
    got = {r.seq: (r.decision, r.reason) for r in L.deduplicate(req.unionByName(spark.createDataFrame([(5, "c", "p")], req.schema)), have, people, "seq").collect()}
    assert got == {
        1: ("NEW_LEAD", "NEW_COMPANY_ONLY"), 2: ("MATCHED_EXISTING_LEAD", "EXACT_COMPANY_ONLY_MATCH"), 3: ("MATCHED_EXISTING_LEAD", "EXACT_COMPANY_PERSON_MATCH"), 4: ("UNRESOLVED", "COMPANY_IDENTITY_UNRESOLVED"),
        5: ("UNRESOLVED", "PERSON_NOT_CURRENTLY_ASSOCIATED_WITH_COMPANY"),
    }
    row = S.export_values(spark.createDataFrame([(None, True, ["a", "b"])], "a string, b boolean, c array<string>")).first()
    assert tuple(row) == ("UNKNOWN", "TRUE", "a;b")


def test_custom_rules_and_blank_attributes(spark):
    icp = spark.createDataFrame([("i", [], [], [], None, None, [], [], ["acme", " "], ["b2b", "eu"])], "icp_id string, industries array<string>, country_codes array<string>, other_places array<string>, min_employees int, max_employees int, titles array<string>, company_types array<string>, excluded array<string>, custom_rules array<string>")
    kind = "icp_id string, company_name string, domain string, industry string, country string, employee_count int, employee_range string, title string, company_type string, custom_answers map<string,boolean>"
    rows = [("i", "x", None, None, None, None, None, None, None, {"b2b": True, "eu": False}), ("i", "", None, None, None, None, None, None, None, {"b2b": True}), ("i", None, None, None, None, None, None, None, None, None)]
    got = {r.company_name: (r.overall, r.reasons) for r in P.evaluate(spark.createDataFrame(rows, kind), icp).collect()}
    assert got == {"x": ("FAIL", ["CUSTOM_RULE_FAILED"]), "": ("HOLD", ["CUSTOM_RULE_UNRESOLVED"]), None: ("HOLD", ["INSUFFICIENT_EVIDENCE", "CUSTOM_RULE_UNRESOLVED", "CUSTOM_RULE_UNRESOLVED"])}


def test_recommendations_spare_hard_rules_and_cold_starts(spark):
    rows = [("hard_rule_result:PASS", 0.9, 40, "HIGH"), ("business_model:DTC", 0.9, 40, "HIGH"), ("x:y", 0.2, 8, "LOW"), ("x:z", 0.6, 40, "HIGH"), ("x:n", None, 40, "HIGH"), ("x:f", 1.0, 3, "INSUFFICIENT_DATA"), ("commercial_signal:ADS", 0.1, 12, "MODERATE")]
    df = spark.createDataFrame(rows, "signal string, rate double, total int, sample string")
    got = {(r.signal, r.recommendation_type, r.effect, r.magnitude) for r in B.recommendations(df).collect()}
    assert got == {("business_model:DTC", "SOFT_PREFERENCE_WEIGHT_HINT", "INCREASE_PRIORITY", 1.0), ("x:y", "RANKING_TIE_BREAK_NUDGE", "DECREASE_PRIORITY", -0.2), ("commercial_signal:ADS", "SOFT_PREFERENCE_WEIGHT_HINT", "DECREASE_PRIORITY", -0.5)}
    assert [(r.signal, r.effect) for r in B.provider_hints(df).collect()] == [("commercial_signal:ADS", "DECREASE_PROVIDER_USAGE")]
    assert B.recommendations(df, True).count() == 0 == B.provider_hints(df, True).count()


KIND = "entity_type string, entity_id string, field string, key string, confidence string, provider string, external_id string, retrieved_at timestamp, id string"


def test_unseen_keeps_the_same_row_however_rows_are_dealt(spark):
    rows = [("COMPANY", "a", "f", "x", "LOW", "p", None, None, str(k)) for k in range(50)]
    df = spark.createDataFrame(rows, KIND)
    for n in (1, 7):
        assert [r.id for r in E.unseen(df.repartition(n), df.limit(0), ["entity_type", "entity_id", "field", "provider", "external_id", "retrieved_at"]).collect()] == ["0"]


def test_a_stream_of_evidence_adds_each_row_once(spark, tmp_path):
    """A real stream over files; a file's rows come again in a later one, and the last batch is replayed by hand."""
    at = dt.datetime(2024, 1, 1)
    first = [("COMPANY", "a", "industry", "x", "LOW", "p", None, at, "1"), ("COMPANY", "b", "industry", "x", "LOW", "p", None, at, "2")]
    second = [*first, ("COMPANY", "a", "industry", "y", "LOW", "q", None, at, "3")]
    store, source = f"file://{tmp_path}/evidence", f"file://{tmp_path}/source"
    schema = spark.createDataFrame([], KIND).schema
    create_store(spark, store, schema)
    seen = {}
    run = ingest_batch(store, lambda df, epoch: seen.__setitem__(epoch, {r.entity_id: r.status for r in df.collect()}), buckets=4)
    for rows in (first, second):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/offsets").trigger(availableNow=True).start().awaitTermination()
    run(spark.createDataFrame(second, KIND), 2)
    assert read_store(spark, store).count() == 3
    assert seen == {0: {"a": "INSUFFICIENT", "b": "INSUFFICIENT"}, 1: {"a": "CONFLICT", "b": "INSUFFICIENT"}, 2: {"a": "CONFLICT", "b": "INSUFFICIENT"}}
