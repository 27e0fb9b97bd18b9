"""Lead-shaped tables derived from the given ones, row by row, so that work grows with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import comparison_key, value_string


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evidence on users: the type is the field, k modulo 2 the value."""
    return as_evidence(table(spark, sf_dir, "events"))


def as_evidence(events: DataFrame) -> DataFrame:
    return events.select(
        F.lit("COMPANY").alias("entity_type"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("field"),
        F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(2)).cast("string").alias("key"),
        F.concat(F.lit("p"), F.pmod("event_id", F.lit(3))).alias("provider"), F.col("ts").alias("retrieved_at"), F.col("event_id").alias("id"),
        F.when(F.col("value") >= 30, "HIGH").when(F.col("value") >= 20, "MEDIUM").otherwise("LOW").alias("confidence"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as candidates of three profiles."""
    places = F.array(F.lit("usa"), F.lit("U.K."), F.lit("Deutschland"), F.lit(" france "), F.lit("Atlantis"), F.lit(None).cast("string"))
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("candidate_id"), F.concat(F.lit("icp"), F.pmod(k, F.lit(3))).alias("icp_id"), F.col("c_name").alias("company_name"),
        F.lit(None).cast("string").alias("domain"), F.col("c_mktsegment").alias("industry"), F.get(places, F.pmod("c_nationkey", F.lit(6))).alias("country"),
        F.when(F.pmod(k, F.lit(4)) != 0, F.abs("c_acctbal").cast("int")).alias("employee_count"),
        F.when(F.pmod(k, F.lit(8)) == 0, "51-200").alias("employee_range"), F.lit("VP of Sales").alias("title"), F.lit(None).cast("string").alias("company_type"),
        F.when(F.pmod(k, F.lit(5)) < 2, F.create_map(F.lit("sells online"), F.pmod(k, F.lit(5)) == 0)).alias("custom_answers"),
    )


def icps(spark: SparkSession) -> DataFrame:
    none: list[str] = []
    rows = [
        ("icp0", ["building", "MACHINERY"], ["US", "GB"], none, 10, 5000, ["Vice President, Sales"], none, ["household"], ["sells online"]),
        ("icp1", none, ["DE"], ["Atlantis"], None, 3000, none, none, none, none),
        ("icp2", ["AUTOMOBILE"], none, none, 100, None, ["CEO"], none, ["furniture"], none),
    ]
    kind = "icp_id string, industries array<string>, country_codes array<string>, other_places array<string>, min_employees int, max_employees int, titles array<string>, company_types array<string>, excluded array<string>, custom_rules array<string>"
    return spark.createDataFrame(rows, kind)


def lead_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as leads of their customer's segment."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")

    def pick(m: int, **values: int):
        out = F.lit(None).cast("string")
        for name, r in values.items():
            out = F.when(F.pmod(k, F.lit(m)) == r, name).otherwise(out)
        return out

    return o.select(
        k.alias("lead_id"), F.col("c_mktsegment").alias("icp_id"), pick(7, FAIL=0, HOLD=1, PASS=2).alias("a"), F.when(F.pmod(k, F.lit(7)) > 2, "PASS").otherwise(pick(7, FAIL=0, HOLD=1, PASS=2)).alias("hard_rule_result"),
        pick(13, DUPLICATE=5).alias("batch_outcome"), pick(17, REJECT=1, ACCEPT=2, HOLD=3).alias("human_review_decision"), pick(5, DISPROVED=0, WEAKENED=1, SURVIVES=2).alias("adversarial_result"),
        pick(6, GOOD_FIT=0, WEAK_FIT=1, NOT_FIT=2, HOLD=3).alias("b"), F.when(F.pmod(k, F.lit(6)) > 3, "GOOD_FIT").otherwise(pick(6, GOOD_FIT=0, WEAK_FIT=1, NOT_FIT=2, HOLD=3)).alias("qualification_decision"),
        F.when(F.pmod(k, F.lit(4)) != 0, F.floor(F.col("o_totalprice") / 1000).cast("double")).alias("final_score"),
    ).drop("a", "b")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as feedback on documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    decision = F.when(F.col("toxic") == 1, "NOT_FIT").when(F.col("quality") == 1, "GOOD_FIT").otherwise("HOLD")
    named = lambda prefix, c: F.concat(F.lit(prefix), c)
    signals = F.array(
        named("business_model:", F.col("lang")), named("commercial_signal:", F.col("source")), named("qualification_decision:", F.pmod("n_chars", F.lit(7)).cast("string")), named("hard_rule_result:", F.col("lang"))
    )
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("lang").alias("icp_id"), decision.alias("decision"), signals.alias("signals"), F.array(F.upper("source"), F.lit("SEEN")).alias("reason_codes"))


def pick(values: tuple, by) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(by, F.lit(len(values))).cast("int"))


WORD = '{"keyword_match": {"terms": ["Skincare"], "term_sources": ["industry"]}}'
WORDS = '{"keyword_match": {"terms": ["x", "beauty"], "term_sources": ["website", "industry"]}}'
BRANCH = '{"industry_match": {"taxonomy_field": "naics", "icp_terms": ["skincare"], "match_scope": "single_category", "branch_total_results": 12}}'
FIELDS = ("company_identity", "domain", "industry", "industry", "country", "employee_count", "employee_range", "company_type", "description", "revenue_range")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as evidence on their customers: entity_type, entity_id, field, value_json, value, key, provider, confidence, retrieved_at, id, evidence_text, external_id."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k, t = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 10)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    value = (
        F.when(F.pmod(k, F.lit(10)) == 0, quoted(F.col("c_name"))).when(F.pmod(k, F.lit(10)) == 1, quoted(F.concat(F.lit("c"), F.col("c_custkey"), F.lit(".com"))))
        .when(F.pmod(k, F.lit(10)).isin(2, 3), quoted(pick(("Skincare", "BUILDING", " beauty", "Gift  Sets"), t))).when(F.pmod(k, F.lit(10)) == 4, pick(('"usa"', '"US"', '"Deutschland"', '"Atlantis"', "null"), t))
        .when(F.pmod(k, F.lit(10)) == 5, F.abs("c_acctbal").cast("int").cast("string")).when(F.pmod(k, F.lit(10)) == 6, pick(('"51-200"', '"201-500"'), t)).when(F.pmod(k, F.lit(10)) == 7, pick(('"DTC brand"', '"Agency"', '"dtc  brand"'), t))
        .when(F.pmod(k, F.lit(10)) == 8, pick(('"A skincare and beauty label"', '"Beauty for all"', '"A DTC brand for skincare"'), t)).otherwise(F.lit('{"max": 5, "min": 1}'))
    )
    rows = o.select(
        F.lit("COMPANY").alias("entity_type"), F.col("o_custkey").cast("string").alias("entity_id"), pick(FIELDS, k).alias("field"), value.alias("value_json"), F.concat(F.lit("p"), F.pmod(k, F.lit(3))).alias("provider"),
        pick(("HIGH", "MEDIUM", "UNKNOWN", "UNKNOWN", "LOW"), F.floor(k / 3)).alias("confidence"), F.col("o_orderdate").alias("retrieved_at"), k.alias("id"),
        F.when(F.pmod(k, F.lit(10)).isin(2, 3), pick((WORD, WORDS, BRANCH), F.floor(k / 20))).alias("evidence_text"), F.col("o_custkey").cast("string").alias("external_id"),
    )
    return rows.withColumns({"key": comparison_key(F.col("field"), F.col("value_json")), "value": F.coalesce(value_string(F.col("value_json")), F.col("value_json"))})


def person_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as evidence on people, one for each part: where they work, and as what."""
    q = F.col("l_partkey")
    value = F.when(F.pmod("l_linenumber", F.lit(2)) == 0, F.concat(F.lit('"'), F.pmod(q, F.lit(150)), F.lit('"'))).otherwise(pick(('"VP of Sales"', '"CEO"'), q))
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("PERSON").alias("entity_type"), F.concat(F.lit("q"), q).alias("entity_id"), F.when(F.pmod("l_linenumber", F.lit(2)) == 0, "company_association").otherwise("current_title").alias("field"), value.alias("value_json"),
        F.concat(F.lit("p"), F.pmod("l_suppkey", F.lit(3))).alias("provider"), F.lit("UNKNOWN").alias("confidence"), F.col("l_shipdate").alias("retrieved_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.lit(None).cast("string").alias("evidence_text"), F.lit(None).cast("string").alias("external_id"),
    )
    return rows.withColumns({"key": comparison_key(F.col("field"), F.col("value_json")), "value": F.coalesce(value_string(F.col("value_json")), F.col("value_json"))})


def evidence_profiles(spark: SparkSession) -> DataFrame:
    none: list[str] = []
    rows = [
        ("icp0", ["Skincare", "Beauty"], none, ["US"], none, 10, 5000, ["Vice President Sales"], none, ["agency"]),
        ("icp1", ["skincare", "Beauty", "gift sets"], ["Gift Sets"], ["DE"], ["atlantis"], None, 3000, none, ["DTC Brand"], none),
        ("icp2", ["Building"], none, none, none, None, None, none, none, none),
    ]
    kind = "icp_id string, industries array<string>, combinations array<string>, country_codes array<string>, other_places array<string>, min_employees int, max_employees int, titles array<string>, company_types array<string>, excluded array<string>"
    return spark.createDataFrame(rows, kind)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer against one profile, every fourth with a person."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("icp"), F.pmod(k, F.lit(3))).alias("icp_id"), k.cast("string").alias("company_id"), F.when(F.pmod(k, F.lit(4)) == 0, F.concat(F.lit("q"), k)).alias("person_id"))
