"""Queries from evidence to validated leads, of discovery rounds, search results, profiles and exports, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import application_folder
from ..operators import assembly as Y
from ..operators import evidence as E
from ..operators import feedback as W
from ..operators import filters as K
from ..operators import imports as I
from ..operators import leads as L
from ..operators import matches as H
from ..operators import provenance as O
from ..operators import ranking as R
from ..operators import rounds as B
from ..operators import search as S
from ..operators import signals as N
from ..operators import tuning as U
from ..operators import validation as Z
from ..operators import verdicts as V
from ..sources import export as X
from ..sources import records as D
from ..streaming.ingest import create_store, ingest_batch
from . import adapters as A

c = F.col
pick = A.pick


def text_list(name: str):
    return F.array_join(name, ",").alias(name)


def _lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Order lines with a number of their own; of those that share it the least."""
    line = A.table(spark, sf_dir, "lineitem").withColumn("candidate_id", c("l_orderkey") * 10 + c("l_linenumber"))
    return line.groupBy("candidate_id").agg(F.min(F.struct(*columns)).alias("r")).select("candidate_id", "r.*")


# --- evidence


def comparison_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of several kinds: places, text, numbers, and objects whose keys stand in another order."""
    k = c("o_orderkey")
    value = pick(('"U.S.A."', '" United   States"', '"EMEA"', "50", '"50"', "50.0", '{"b": [1, {"d": 2, "c": 1}], "a": 1}', "null", "true"), k)
    field = pick(("country", "industry"), F.floor(k / 9))
    return A.table(spark, sf_dir, "orders").select(k, E.comparison_key(field, value).alias("key"))


def fact_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one trusted source, so that structured support occurs."""
    return E.field_status(A.facts(spark, sf_dir), ("p1",)).select("entity_id", "field", "status", "n_rows", "corroborated", "value")


def all_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    everyone = A.asked(spark, sf_dir).select(F.lit("COMPANY").alias("entity_type"), c("company_id").alias("entity_id"))
    return E.all_fields(E.field_status(A.facts(spark, sf_dir)), everyone).select("entity_id", "field", "status", "critical")


def lead_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = A.asked(spark, sf_dir).withColumn("lead_id", c("company_id"))
    companies = E.entity_summary(E.field_status(A.facts(spark, sf_dir)), E.COMPANY_CRITICAL)
    people = E.entity_summary(E.field_status(A.person_facts(spark, sf_dir)), E.PERSON_CRITICAL)
    return E.lead_fields(leads, companies, people).select("lead_id", text_list("conflicting"), text_list("missing"))


def supported_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = A.asked(spark, sf_dir).withColumn("lead_id", c("company_id"))
    status = E.field_status(A.facts(spark, sf_dir).unionByName(A.person_facts(spark, sf_dir)))
    return E.supported_values(leads, status).select("lead_id", F.explode("verified").alias("field", "value"))


def conflicting_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.conflicting_facts(A.facts(spark, sf_dir).withColumnRenamed("entity_id", "company_id"))


def supporting_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.facts(spark, sf_dir)
    everyone = A.asked(spark, sf_dir).select(F.lit("COMPANY").alias("entity_type"), c("company_id").alias("entity_id"))
    return E.supporting_evidence(E.all_fields(E.field_status(rows), everyone), rows).select("entity_id", "field", "status", "evidence_id")


def verified_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth order's row is a stored answer, the others are evidence."""
    rows = A.facts(spark, sf_dir)
    known, answers = rows.where("pmod(id, 5) > 0"), rows.where("pmod(id, 5) = 0")
    made = E.verify_fields(E.field_status(known), known, answers, spark.createDataFrame([("p0",), ("p1",), ("p2",)], "provider string"))
    return made.select("entity_id", "field", "execution", "outcome", "original_status", "resulting_status", "n_new")


def field_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As of 2002, in which year's first half the newest orders fall out of date."""
    score = E.freshness_score(c("newest"), F.lit("2002-01-01 00:00:00").cast("timestamp"))
    made = E.field_status(A.facts(spark, sf_dir)).select("entity_id", "field", score.alias("s"))
    return made.select("entity_id", "field", F.round("s", 6).alias("freshness"), E.is_stale(c("s")).alias("is_stale"))


def split_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c("l_suppkey").alias("batch_id"), c("l_returnflag").alias("provider_id"), F.pmod("l_partkey", F.lit(50)).alias("external_id"))
    return E.split_seen(rows.where("l_linenumber > 3"), rows.where("l_linenumber <= 3")).groupBy("batch_id", "is_repeat").agg(F.count("*").alias("n"))


def streamed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of evidence: each batch adds what is new to a store and gives the status of the entities it touched; the last one of each counts."""
    folder = f"{application_folder(spark)}/stream-{uuid.uuid4().hex}"
    A.table(spark, sf_dir, "events").repartition(8, "event_id").write.parquet(f"{folder}/source")
    events = spark.readStream.schema(A.table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/source")
    stream = A.as_evidence(events).withColumn("external_id", F.lit(None).cast("string"))
    create_store(spark, f"{folder}/store", stream.schema)
    keep = lambda status, epoch: status.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{folder}/status")
    query = stream.writeStream.foreachBatch(ingest_batch(f"{folder}/store", keep, 32)).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/status")
    return rows.groupBy("entity_id", "field").agg(F.max_by(F.struct("status", "n_rows"), "epoch").alias("s")).select("entity_id", "field", "s.*")


# --- imports


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("o_orderkey")
    none = F.lit(None)
    some = lambda m, v: F.when(F.pmod(k, F.lit(m)) == 0, v)
    array = lambda *x: F.array(*map(F.lit, x))
    empty = F.array().cast("array<string>")
    values = {
        "employee_count": some(2, k.cast("int")), "industry": some(3, pick(("Skin \"care\"", "", "Beauty"), F.floor(k / 3))), "country": some(5, F.lit("US")), "description": some(7, F.lit("a text")),
        "industry_match_branch": some(2, F.lit("naics")), "industry_match_terms": F.when(F.pmod(k, F.lit(4)) == 0, array("Skincare", "Beauty")).when(F.pmod(k, F.lit(4)) == 2, empty), "industry_match_scope": some(8, F.lit("multi_category")),
        "industry_match_branch_total_results": some(3, F.lit(12)), "keyword_match_terms": some(9, array("Beauty")), "keyword_match_term_sources": some(27, array("industry")), "company_type_match_branch": some(2, F.lit("types")),
        "company_type_match_terms": F.when(F.pmod(k, F.lit(6)) == 0, array("DTC")).when(F.pmod(k, F.lit(6)) == 2, array("DTC", "B2B")), "company_type_match_resolved_category_count": F.pmod(k, F.lit(5)).cast("int"),
    }
    shape = [x.strip().rsplit(" ", 1) for x in I.ATTRIBUTES.split(", ")]
    attributes = F.struct(*[values.get(n, none).cast(t).alias(n) for n, t in shape])
    return A.table(spark, sf_dir, "orders").select(k.alias("candidate_id"), F.concat(F.lit("p"), F.pmod(k, F.lit(3))).alias("provider_id"), k.cast("string").alias("external_id"), F.concat(F.lit("Company "), "o_custkey").alias("name"),
                                                   some(2, F.concat(F.lit("c"), "o_custkey", F.lit(".com"))).alias("domain"), c("o_orderdate").alias("discovered_at"), attributes.alias("attributes"), "o_custkey")


def company_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sightings(spark, sf_dir)
    resolved = rows.select("candidate_id", F.when(F.pmod("o_custkey", F.lit(4)) > 0, c("o_custkey")).alias("company_id"))
    return I.company_evidence(rows, resolved).select("entity_id", "external_id", "field", "value_json", "evidence_text")


def person_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = c("l_partkey")
    rows = _lines(spark, sf_dir, "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate").select(
        "candidate_id", F.concat(F.lit("Ann "), q).alias("name"), F.when(F.pmod(q, F.lit(2)) == 0, "CEO").alias("title"), F.when(F.pmod(q, F.lit(3)) > 0, c("l_suppkey")).alias("company_id"),
        F.when(F.pmod(q, F.lit(4)) == 0, F.create_map(F.lit("linkedin_id"), F.concat(F.lit("IN/p"), q, F.lit("/")))).when(F.pmod(q, F.lit(4)) == 1, F.create_map(F.lit("linkedin_url"), F.concat(F.lit("https://www.LinkedIn.com/in/p"), q))).alias("attributes"),
        c("l_returnflag").alias("provider_id"), F.lit("x").alias("external_id"), c("l_shipdate").alias("discovered_at"), q.alias("person_id"),
    )
    made = I.person_evidence(rows, rows.select("candidate_id", F.when(c("person_id") > 10, c("person_id")).alias("person_id")))
    return made.groupBy("field", "value_json").agg(F.count("*").alias("n"))


def fact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = A.table(spark, sf_dir, "lineitem")
    facts = line.select(c("l_partkey").alias("company_id"), c("l_returnflag").alias("field"), c("l_linestatus").alias("value_json"), c("l_linestatus").alias("provider_id"), F.lit(None).cast("string").alias("external_id"), c("l_shipdate").alias("retrieved_at"), F.when(c("l_quantity") > 5, c("l_quantity") / 50).alias("confidence"))
    return I.fact_evidence(facts).groupBy("entity_id", "confidence").agg(F.count("*").alias("n"))


def discovery_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.discovery_matches(A.facts(spark, sf_dir)).select("company_id", "match_type", text_list("keyword_terms"), text_list("keyword_sources"), "scope", "total_results")


# --- validation


def corroborated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.covered_by_keywords(A.facts(spark, sf_dir), A.asked(spark, sf_dir), A.evidence_profiles(spark)).select("icp_id", "company_id", F.array_join("corroborated", "|").alias("corroborated"))


def unprovable_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.unprovable_industries(A.facts(spark, sf_dir), A.asked(spark, sf_dir), A.evidence_profiles(spark))


def described_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked, icps = A.facts(spark, sf_dir), A.asked(spark, sf_dir), A.evidence_profiles(spark)
    both = [Z.described(rows, asked, icps, t).withColumn("list", F.lit(t)) for t in ("industries", "company_types")]
    return both[0].unionByName(both[1])


def _with_values(spark: SparkSession, sf_dir: str, people: bool = True) -> tuple[DataFrame, DataFrame]:
    rows = A.facts(spark, sf_dir).unionByName(A.person_facts(spark, sf_dir)) if people else A.facts(spark, sf_dir)
    return rows, E.field_status(rows.withColumn("value", c("value_json")))


def validated_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, status = _with_values(spark, sf_dir)
    return Z.validate(A.asked(spark, sf_dir), A.evidence_profiles(spark), rows, status).select("icp_id", "company_id", "person_id", "overall", text_list("reasons"))


def cited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, status = _with_values(spark, sf_dir)
    return Z.cited_rows(A.asked(spark, sf_dir), A.evidence_profiles(spark), rows, status)


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("c_custkey")
    array = lambda *x: F.array(*map(F.lit, x))
    some = lambda m, v, other=None: F.when(F.pmod(k, F.lit(m)) == 0, v).otherwise(other if other is not None else F.array().cast("array<string>"))
    return A.table(spark, sf_dir, "customer").select(
        k.alias("icp_id"), some(3, array(" Skin  care ", "skin CARE", "Beauty", " ")).alias("industries"), some(4, array("usa", "EMEA", "U.S.", "emea "), some(5, array("France", "Narnia", "france"))).alias("geography"),
        some(6, array("VP")).alias("titles"), F.lit(None).cast("array<string>").alias("company_types"), some(9, array("beauty")).alias("excluded"), some(2, array("b2b")).alias("preferences"),
        F.when(F.pmod(k, F.lit(7)) == 0, 50).alias("min_employees"), F.when(F.pmod(k, F.lit(14)) == 0, 10).alias("max_employees"),
        F.array(F.concat(F.lit("  sells to  "), "c_mktsegment", F.lit("\t")), F.lit("Ships  abroad")).alias("custom_rules"),
    )


def profile_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.profile_errors(_profiles(spark, sf_dir)).select("icp_id", text_list("errors"))


def canonical_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = Z.canonical_profiles(_profiles(spark, sf_dir), U.clean_terms, T.country_code)
    return made.select("icp_id", text_list("industries"), text_list("country_codes"), text_list("country_texts"), text_list("other_places"), text_list("excluded"), text_list("custom_rules"), "min_employees")


def projected_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as criteria of the profile of their order."""
    line = A.table(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])
    key = pick(("industry", "geography", "employee_range", "exclusions", "custom", "funding", "industry", "colour"), c("l_linenumber") + F.when(F.pmod("l_orderkey", F.lit(10)) == 0, 1).otherwise(0) - 1)
    op = F.when(key == "employee_range", "range").when(key == "exclusions", "not_in").when(key == "custom", F.when(F.pmod("l_orderkey", F.lit(17)) == 0, "in").otherwise("contains")).otherwise("in")
    rows = line.select(c("l_orderkey").alias("icp_id"), c("l_linenumber").alias("pos"), key.alias("key"), op.alias("operator"), F.when(~key.isin("employee_range", "custom"), F.array(F.concat(F.lit("t"), "l_linenumber"))).alias("terms"),
                       F.when(key == "employee_range", 10).alias("low"), F.when(key == "employee_range", c("l_linenumber")).alias("high"), F.lit(None).cast("string").alias("label"), F.when(key == "custom", "sells online").alias("text"))
    made = K.project(rows)
    labels = lambda x: F.array_join(F.transform(x, lambda r: F.concat(r["label"], F.lit("="), r["description"])), ",").alias(x)
    return made.select("icp_id", text_list("errors"), text_list("industry"), text_list("geography"), text_list("exclusions"), "min_employees", "max_employees", labels("custom_rules"), labels("other_preferences"))


def asking_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as what somebody asks for in a few sentences of their own segment, nation and name."""
    k, segment = c("c_custkey"), F.lower("c_mktsegment")
    when = lambda m, r, text: F.when(F.pmod(k, F.lit(m)) == r, text).otherwise("")
    text = F.concat(
        F.lit("Find "), when(5, 0, F.lit("saas and d2c ")), segment, F.lit(" companies in "), pick(("canada", "uae", "france", "the us"), c("c_nationkey")), F.lit(" with "), k, F.lit("-"), k + 500, F.lit(" employees"),
        when(3, 0, F.concat(F.lit(". Excluding "), segment, F.lit(" vendors, SaaS except for e-commerce shops"))), when(4, 1, F.concat(F.lit(". Revenue of $"), k, F.lit("M to $2B"))),
        when(2, 0, F.concat(F.lit(". They sell to every "), segment, F.lit(" buyer as "), "c_name")), F.lit("."),
    )
    return A.table(spark, sf_dir, "customer").select(k.alias("icp_id"), text.alias("text"))


def extracted_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = K.extracted(asking_texts(spark, sf_dir), "text")
    lists = [F.array_join(n, "|").alias(n) for n in (*K.TERMS, "exclusions", "requirements", "unmatched")]
    return made.select("icp_id", *lists, "min_employees", "max_employees", "min_revenue", "max_revenue")


def filter_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms, clauses and ranges in every turn of every conversation, by place."""
    made = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(K.spans(c("text"))).alias("s"))
    return made.select("conv_id", "turn", "s.*")


def merged_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.concat_ws(" ", "p_type", "p_name"), " ")
    rows = A.table(spark, sf_dir, "part").select(
        "p_partkey", F.slice(words, 1, 1).alias("industries"), F.lit(None).cast("array<string>").alias("combinations"), F.array(F.lit("DTC")).alias("company_types"), F.array().cast("array<string>").alias("excluded"),
        F.transform(words, lambda w: F.lower(w)).alias("industry_terms"), F.array(F.upper("p_type"), F.lit("Gift")).alias("combination_terms"), F.array(F.lit("dtc"), F.lit("B2B"), F.lit("b2b")).alias("company_type_terms"), F.lit(None).cast("array<string>").alias("exclusion_terms"),
    )
    return K.merge_strategy(rows).select("p_partkey", text_list("industries"), text_list("combinations"), text_list("company_types"), text_list("excluded"))


# --- search and vendors


def size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.when(F.pmod("c_custkey", F.lit(3)) > 0, F.pmod("c_custkey", F.lit(700)) * 3), F.when(F.pmod("c_custkey", F.lit(4)) > 0, F.pmod("c_custkey", F.lit(900)) * 7)
    return A.table(spark, sf_dir, "customer").select("c_custkey", F.array_join(S.size_buckets(low, high), ",").alias("sizes"))


URLS = (
    "https://www.ycombinator.com/companies/acme-co", "https://ycombinator.com/companies/industry/fintech", "https://www.crunchbase.com/organization/acme", "https://jobs.lever.co/acme-co/123", "https://boards.greenhouse.io/acme_labs/jobs/1",
    "https://acme.com/about", "http://uk.linkedin.com/company/acme", "https://acme.com/company/profile/", "ftp",
)
TITLES = ("Acme: the shop | Y Combinator", "Acme - Crunchbase Company Profile & Funding", "Acme Ltd - Engineer", "")


def directory_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, title = pick(URLS, c("o_orderkey")), pick(TITLES, F.floor(c("o_orderkey") / 9))
    found = S.directory_result(url, title)
    return A.table(spark, sf_dir, "orders").select("o_orderkey", found["external_id"].alias("external_id"), found["name"].alias("name"), S.may_be_homepage(url).alias("homepage"), S.is_block_page(pick(("ok", "Error 403: no", "Forbidden"), c("o_orderkey"))).alias("blocked"))


def resolved_homepages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("c_custkey")
    companies = A.table(spark, sf_dir, "customer").select(k.alias("candidate_id"), F.lit("Acme Tea").alias("name"), pick(("The Acme tea house, organic leaves for the home", "tea", "organic leaves and home roasted coffee"), k).alias("description"))
    o = c("o_orderkey")
    results = A.table(spark, sf_dir, "orders").select(
        c("o_custkey").alias("candidate_id"), o.alias("position"), F.concat(pick(("https://www.", "https://uk.linkedin.com/company/", "https://", "mailto:"), o), F.lit("shop"), o, F.lit(".com/"), pick(("", "b/x"), F.floor(o / 4))).alias("url"),
        F.lit("Acme Tea").alias("title"), pick(("organic leaves", "tea house", "coffee roasted at home"), F.floor(o / 8)).alias("content"),
    )
    return S.homepages(companies, results)


def vendor_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored answers of six forms on their customers; one in eleven is cut off."""
    k, named = c("o_orderkey"), lambda **x: F.struct(*[v.alias(n) for n, v in x.items()])
    text = k.cast("string")
    forms = {
        "people_search": named(items=F.array(
            named(id=text, name=c("c_name"), current_positions=F.array(named(role=F.concat(F.lit("Head of "), "o_orderpriority"), company=c("c_mktsegment"))), public_identifier=F.concat(F.lit("P"), text), profile_url=F.lit("x")),
            named(id=F.lit(""), name=F.lit("none"), current_positions=F.array(named(role=F.lit("x"), company=F.lit("x"))), public_identifier=F.lit(None).cast("string"), profile_url=F.lit("x")),
            named(id=F.concat(text, F.lit("b")), name=F.lit("Bo"), current_positions=F.array().cast("array<struct<role:string,company:string>>"), public_identifier=F.lit(None).cast("string"), profile_url=F.lit("https://linkedin.com/in/Bo/")),
        )),
        "person_match": named(person=named(id=text, name=c("c_name"), title=c("c_mktsegment"), email=F.concat(text, F.lit("@x.com")), email_status=pick(("verified", "guessed", "", None), F.floor(k / 6)), linkedin_url=F.lit(""))),
        "registry": named(results=named(bindings=F.array(
            named(industryLabel=named(value=F.lit("")), inception=named(value=F.lit(None).cast("string")), itemLabel=named(value=F.lit("first"))), named(industryLabel=named(value=c("c_mktsegment")), inception=named(value=c("o_orderdate").cast("string")), itemLabel=named(value=c("c_name"))),
        ))),
        "filings": named(sicDescription=c("c_mktsegment"), addresses=named(business=named(stateOrCountryDescription=F.concat(F.lit("N"), "c_nationkey")))),
        "email_check": named(is_disposable_email=named(value=F.pmod(k, F.lit(4)) == 0, text=F.lit("x")), is_role_email=named(value=F.lit("true"))),
        "phone_check": named(valid=F.pmod(k, F.lit(4)) == 1, type=pick(("mobile", "fixed"), F.floor(k / 6)), carrier=F.lit("")),
    }
    kinds, body = list(forms), F.lit(None).cast("string")
    for n, form in enumerate(kinds):
        body = F.when(F.pmod(k, F.lit(6)) == n, F.to_json(forms[form])).otherwise(body)
    rows = A.table(spark, sf_dir, "orders").join(A.table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey"))
    return rows.select(k.alias("entity_id"), F.concat(F.lit("v"), F.pmod(k, F.lit(6))).alias("provider"), pick(tuple(kinds), k).alias("form"), F.when(F.pmod(k, F.lit(11)) == 0, F.substring(body, 1, 10)).otherwise(body).alias("body"))


def vendor_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stated_confidence(S.vendor_facts(vendor_answers(spark, sf_dir)))


def vendor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("o_orderkey")
    body = F.concat(F.lit('{"id": "'), F.when(F.pmod(k, F.lit(7)) > 0, k.cast("string")).otherwise(F.lit("")), F.lit('", "firm": {"title": '), pick(('"Acme"', "null", '"B \\"x\\""'), k), F.lit('}, "size": '), F.pmod(k, F.lit(5)), F.lit("}"))
    answers = A.table(spark, sf_dir, "orders").select(c("o_custkey").alias("run_id"), body.alias("body"))
    made = D.vendor_records(answers, "body", {"employee_count": "$.size", "city": "$.firm.city"}, "$.id", "$.firm.title")
    return made.select("run_id", "external_id", "name", F.map_keys("attributes")[0].alias("only"), c("attributes")["employee_count"].alias("employee_count"))


def profile_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("o_orderkey")
    attributes = F.create_map(F.lit("linkedin_id"), pick(("", "IN/Ann/", None), k), F.lit("linkedin_url"), pick(("https://www.linkedin.com/in/Bob//", "linkedin.com/in/x", "HTTP://LinkedIn.com/ company/y ", "/"), F.floor(k / 3)))
    return A.table(spark, sf_dir, "orders").select(k, T.profile_id(attributes).alias("profile_id"))


def branch_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order's part from two branches: tagged, then merged."""
    line = A.table(spark, sf_dir, "lineitem").withColumn("seq", c("l_orderkey") * 10 + c("l_linenumber")).groupBy("seq").agg(*[F.min(x).alias(x) for x in ("l_partkey", "l_returnflag", "l_linestatus", "l_quantity")])
    tags = D.branch_tags("industry_match", c("l_linestatus"), F.array(c("l_returnflag")), F.when(c("l_quantity") > 25, F.array(c("l_linestatus"))).otherwise(F.array(c("l_linestatus"), c("l_returnflag"))))
    words = D.branch_tags("keyword_match", c("l_linestatus"), F.array(F.concat("l_returnflag", "l_linestatus"), c("l_returnflag")), F.array())
    a = line.where("l_linestatus = 'F'").withColumns(tags).select("l_partkey", "seq", *tags)
    b = line.where("l_linestatus <> 'F'").withColumns(words).select("l_partkey", "seq", *words)
    lists = ["industry_match_terms", "industry_match_resolved_values", "keyword_match_terms"]
    made = L.merged_sightings([a, b], ["l_partkey"], "seq", lists)
    return made.select("l_partkey", "seq", "industry_match_scope", "industry_match_resolved_category_count", *[text_list(x) for x in lists])


# --- rounds


def allowed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("o_orderkey")
    return A.table(spark, sf_dir, "orders").select(k, B.allowed_source(pick(("fast", "safe", "deep", None), k), pick(("tavily-company-discovery-v1", "other", None), F.floor(k / 4))).alias("allowed"))


def mock_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("entity_id"), pick(("mock-a", None, "real", "mock-b"), c("l_partkey")).alias("provider"))
    return B.mock_entities(A.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("entity_id")), rows)


def reopened_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("o_orderkey")
    items = A.table(spark, sf_dir, "orders").select(k, c("o_orderpriority").alias("batch_id"), c("o_custkey").alias("company_id"), pick(("HELD", "ACCEPTED", "REJECTED"), k).alias("outcome"), F.lit("x").alias("qualification_decision"), F.lit("HOLD").alias("hard_rule_result"), F.lit("DONE").alias("stage"))
    touched = A.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(c("o_orderpriority").alias("batch_id"), c("o_custkey").alias("company_id"))
    return B.reopened(items, touched).select("o_orderkey", "outcome", "hard_rule_result", "stage")


def new_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("lead_id"), c("l_returnflag").alias("icp_id"), c("l_linenumber").alias("icp_version"))
    return B.new_memberships(rows, rows.where("icp_version < 3 or pmod(lead_id, 5) = 0"))


def linked_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir, "l_partkey", "l_suppkey", "l_returnflag", "l_linenumber").select("candidate_id", c("l_returnflag").alias("provider_id"), c("l_partkey").alias("external_id"), F.when(F.pmod("l_suppkey", F.lit(3)) > 0, c("l_suppkey")).alias("company_id"), "l_linenumber")
    return O.linked_repeats(rows.where("l_linenumber > 3").drop("company_id"), rows.where("l_linenumber <= 3")).groupBy("company_id").agg(F.count("*").alias("n"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = A.lead_signals(spark, sf_dir).withColumns({"tier": R.tier(), "outcome": pick(("ACCEPTED", "HELD", "REJECTED", "DUPLICATE", None), c("lead_id"))})
    failed = spark.createDataFrame([("BUILDING", 2), ("OTHER", 0)], "icp_id string, failed_count int")
    return B.run_summary(leads, failed, "icp_id")


def _lead_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as leads of their customer's segment."""
    k, none = c("lead_id"), F.array().cast("array<string>")
    ready = V.readiness(
        c("hard_rule_result"), F.lit(True), F.when(F.pmod(k, F.lit(9)) == 0, F.array(F.lit("x"))).otherwise(none), F.when(F.pmod(k, F.lit(4)) == 0, F.array(F.lit("x"))).otherwise(none), F.lit(None).cast("string"),
        c("qualification_decision"), c("adversarial_result"), c("human_review_decision"), F.coalesce(c("batch_outcome") == "DUPLICATE", F.lit(False)),
    )
    leads = A.lead_signals(spark, sf_dir).withColumns({"tier": R.tier(), "readiness": ready["level"], "company_id": F.pmod(k, F.lit(97)), "person_id": F.when(F.pmod(k, F.lit(3)) == 0, k + 1)})
    return B.lead_statuses(leads, "icp_id")


def lead_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lead_statuses(spark, sf_dir)


def stage_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the items of their customer's segment; those that were returned failed."""
    o = A.table(spark, sf_dir, "orders").join(A.table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey"))
    items = A.table(spark, sf_dir, "lineitem").join(o, c("l_orderkey") == c("o_orderkey")).select(c("c_mktsegment").alias("icp_id"), F.when(c("l_returnflag") == "R", "FAILED").otherwise("HELD").alias("outcome"))
    return B.stage_tallies(items, _lead_statuses(spark, sf_dir), "icp_id")


# --- matches


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as companies, every third without a domain; order lines as candidates that matched them. No two of them claim one domain."""
    s = c("s_suppkey")
    old = A.table(spark, sf_dir, "supplier").select(s.alias("company_id"), c("s_name").alias("name"), F.when(F.pmod(s, F.lit(3)) > 0, F.concat(F.lit("s"), s, F.lit(".com"))).alias("domain"), F.array(F.lit("Old name")).alias("aliases"), F.when(F.pmod(s, F.lit(2)) == 0, F.create_map(F.lit("A"), s.cast("string"))).otherwise(F.create_map().cast("map<string,string>")).alias("provider_ids"))
    line = _lines(spark, sf_dir, "l_suppkey", "l_returnflag", "l_linestatus", "l_partkey", "l_shipdate")
    rows = line.select(F.format_string("%09d", "candidate_id").alias("candidate_id"), c("l_suppkey").alias("company_id"), c("l_returnflag").alias("provider_id"), F.pmod("l_partkey", F.lit(4)).cast("string").alias("external_id"), F.concat(pick(("Old NAME", "New ", "new "), c("l_partkey")), F.when(F.pmod("l_partkey", F.lit(3)) > 0, "x").otherwise("")).alias("name"),
                       F.when(c("l_linestatus") == "F", F.concat(F.lit("https://s"), "l_suppkey", F.lit(".com/x"))).when(F.pmod("l_partkey", F.lit(5)) == 0, F.lit("s1.com")).alias("domain"), c("l_shipdate").alias("discovered_at"))
    return old, rows


def applied_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = H.apply_company_matches(*_matched(spark, sf_dir))
    ids = F.array_join(F.transform(F.array_sort(F.map_entries("provider_ids")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return made.select("company_id", "domain", F.array_join("aliases", "|").alias("aliases"), ids.alias("ids"))


def match_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = H.apply_company_matches(*_matched(spark, sf_dir))
    return found.groupBy(text_list("conflicts")).agg(F.count("*").alias("n"))


def applied_person_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = c("p_partkey")
    old = A.table(spark, sf_dir, "part").select(q.alias("person_id"), F.lit("Ann").alias("name"), F.lit(None).cast("array<string>").alias("aliases"), F.create_map().cast("map<string,string>").alias("provider_ids"), F.when(F.pmod(q, F.lit(3)) == 0, "in/old").alias("profile_id"), F.when(F.pmod(q, F.lit(2)) == 0, "7").alias("company_id"), F.array(F.lit("7")).alias("companies"))
    line = _lines(spark, sf_dir, "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")
    rows = line.select(F.format_string("%09d", "candidate_id").alias("candidate_id"), c("l_partkey").alias("person_id"), c("l_returnflag").alias("provider_id"), F.lit("e").alias("external_id"), F.lit("ANN").alias("name"), F.when(F.pmod("l_suppkey", F.lit(4)) > 0, c("l_suppkey")).alias("company_id"),
                       F.create_map(F.lit("linkedin_id"), F.when(F.pmod("l_suppkey", F.lit(2)) == 0, F.concat(F.lit("in/s"), "l_suppkey")), F.lit("linkedin_url"), F.lit(None).cast("string")).alias("attributes"), c("l_shipdate").alias("discovered_at"))
    made, found = H.apply_person_matches(old, rows)
    clash = found.where("array_contains(conflicts, 'linkedin_id_conflict')").join(rows.select("candidate_id", "person_id"), "candidate_id").groupBy("person_id").agg(F.count("*").alias("n_clash"))
    return made.join(clash, "person_id", "left").select("person_id", F.size("aliases").alias("n_aliases"), F.array_join(F.array_sort(F.map_keys("provider_ids")), ",").alias("providers"), "profile_id", "company_id", F.array_join("companies", ",").alias("companies"), "n_clash")


# --- assembled leads


def _histories(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Order lines as the histories of leads: the order's customer is the company, its status the profile."""
    o = A.table(spark, sf_dir, "orders")
    members = o.select(c("o_orderstatus").alias("icp_id"), c("o_orderkey").alias("lead_id"), c("o_custkey").alias("company_id"), F.when(F.pmod("o_orderkey", F.lit(3)) == 0, c("o_orderkey") + 1).alias("person_id"))
    line = _lines(spark, sf_dir, "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_tax").withColumnRenamed("candidate_id", "id")
    rows = line.join(members, c("l_orderkey") == c("lead_id")).withColumn("at", c("l_shipdate"))
    q = c("l_partkey")
    part = lambda m, cols: rows.where(F.pmod("l_suppkey", F.lit(7)) == m).select("icp_id", "lead_id", "company_id", "person_id", "at", "id", *cols)
    verdicts = part(3, [pick(("GOOD_FIT", "WEAK_FIT", "NOT_FIT"), q).alias("decision"), F.pmod(q, F.lit(100)).cast("double").alias("confidence"), F.lit("fits").alias("summary")])
    return {
        "members": members.unionByName(members.where("pmod(lead_id, 10) = 0")), "validations": part(0, [pick(("PASS", "PASS", "HOLD", "FAIL"), q).alias("overall"), F.array(F.lit("X")).alias("reasons")]).unionByName(part(1, [F.lit("PASS").alias("overall"), F.array(F.lit("Y")).alias("reasons")])),
        "scores": part(2, [c("l_quantity").alias(x) for x in ("final_score", "icp_score", "commercial_score", "evidence_score", "freshness_score", "identity_confidence")]), "quality": part(4, [c("l_quantity").alias("score"), F.lit("REVIEW").alias("label")]),
        "verdicts": verdicts, "second": verdicts.where("pmod(id, 2) = 0").select(c("id").alias("qualification_id"), "at", (c("id") + 5).alias("id"), pick(("SURVIVES", "WEAKENED", "DISPROVED"), c("id")).alias("result"), F.lit(50.0).alias("confidence")),
        "reviews": part(5, [pick(("ACCEPT", "HOLD", "REJECT"), q).alias("decision"), F.array(F.lit("SEEN")).alias("reasons")]), "items": part(6, [pick(("ACCEPTED", "DUPLICATE"), q).alias("outcome")]),
        "conflicts": o.where("pmod(o_custkey, 11) = 0").select(c("o_custkey").alias("entity_id")), "verifications": rows.where("l_tax > 0.07").select(c("company_id").alias("entity_id"), pick(("UNRESOLVED", "RESOLVED", "HOLD"), q).alias("outcome")),
    }


def assembled_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = Y.lead_signals(**_histories(spark, sf_dir))
    return made.select("icp_id", "lead_id", "hard_rule_result", "final_score", "company_quality_score", "qualification_decision", "qualification_confidence", "adversarial_result", "human_review_decision", "batch_outcome", "evidence_has_conflicts", "verification_unresolved")


def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ranked leads of their priority, copied on three days, one of them twice and without one profile; read as of a day between."""
    o = A.table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("icp_id"), c("o_orderkey").alias("lead_id"), c("o_orderdate").alias("day"), c("o_totalprice").alias("score"))
    path = f"{application_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    for date, without in (("1996-01-01", ""), ("1998-01-01", "3"), ("1998-01-01", "3"), ("2000-01-01", "")):
        X.append_snapshot(o.where((c("day") < date) & (c("icp_id") != without)), path, date)
    return X.read_snapshot(spark, path, "1999-06-30").groupBy("icp_id", "snapshot_date").agg(F.count("*").alias("n"), F.sum("lead_id").alias("leads"))


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = Y.ranked(Y.lead_signals(**_histories(spark, sf_dir)))
    cust = A.table(spark, sf_dir, "customer")
    companies = cust.select(c("c_custkey").alias("company_id"), c("c_name").alias("name"), F.concat(F.lit("c"), "c_custkey", F.lit(".com")).alias("domain"), F.create_map(F.lit("pa"), F.lit("1")).alias("provider_ids"))
    people = A.table(spark, sf_dir, "orders").select((c("o_orderkey") + 1).alias("person_id"), F.concat(F.lit("Ann Lee "), pick(("Roe", "Jr.", "x"), c("o_orderkey"))).alias("name"), F.concat(F.lit("in/"), "o_orderkey").alias("profile_id"), F.create_map(F.lit("pb"), F.lit("1")).alias("provider_ids"))
    leads = A.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("lead_id")).distinct()
    fields = leads.select("lead_id", F.array(F.lit("industry")).alias("conflicting"), F.array().cast("array<string>").alias("missing"))
    mail = leads.select("lead_id", F.when(F.pmod("lead_id", F.lit(4)) == 0, F.create_map(F.lit("person.email"), F.lit("a@b.c"))).otherwise(F.create_map().cast("map<string,string>")).alias("verified"))
    line = A.table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("lead_id"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"))
    ids = {"evidence_ids": line, "verification_ids": line.where("pmod(id, 3) = 0"), "deduplication_ids": line.where("pmod(id, 10) = 1")}
    resolutions = {"company_resolution_id": cust.select(c("c_custkey").alias("company_id"), c("c_custkey").alias("id")), "person_resolution_id": people.select("person_id", c("person_id").alias("id"))}
    fixed = {"schema_version": F.lit("1.0.0"), "icp_version": F.lit(1), "batch_id": F.lit(None).cast("string"), "exported_at": F.lit("2024-02-01 00:00:00").cast("timestamp")}
    return Y.export_leads(ranked, companies, people, fields, mail, ids, resolutions, fixed)


def exported_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.export_values(_exported(spark, sf_dir).select(*X.COLUMNS))


def stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a store of leads, memberships and evidence, written with some of the declared columns and read with all of them."""
    folder, o = f"{application_folder(spark)}/stored-{uuid.uuid4().hex}", A.table(spark, sf_dir, "orders")
    o.select(c("o_orderkey").cast("string").alias("id"), c("o_custkey").cast("string").alias("company_id")).write.parquet(f"{folder}/canonical_leads")
    o.select(c("o_orderkey").cast("string").alias("lead_id"), c("o_orderstatus").alias("icp_id"), F.lit("not declared").alias("note")).write.parquet(f"{folder}/lead_icp_memberships")
    A.facts(spark, sf_dir).select(c("id").cast("string").alias("id"), "entity_type", "entity_id", "field", "value_json").write.parquet(f"{folder}/evidence")
    leads, members, rows = (D.read_table(spark, folder, n) for n in ("canonical_leads", "lead_icp_memberships", "evidence"))
    told = rows.groupBy(c("entity_id").alias("company_id")).agg(F.count("*").alias("n_rows"), F.count("source_url").alias("n_urls"))
    made = members.join(leads, c("lead_id") == c("id")).groupBy("icp_id", "company_id").agg(F.count("*").alias("n_leads"), F.count("person_id").alias("n_people"), F.count("icp_version").alias("n_versions"))
    return made.join(told, "company_id")


def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested export, written and read again: leads by profile and tier, beside what the export's heads say of the profile."""
    path = f"{application_folder(spark)}/export-{uuid.uuid4().hex}"
    X.write_json(_exported(spark, sf_dir), path, "gzip")
    leads, heads = spark.read.json(f"{path}/leads"), spark.read.json(f"{path}/metadata")
    made = leads.groupBy("icp_id", "tier").agg(F.count("*").alias("n"), F.min("rank").alias("best"), F.count(c("identity.person_id")).alias("n_people"))
    return made.join(heads.select("icp_id", "lead_count"), "icp_id")


def value_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON values: lists, objects, strings, numbers and nothing."""
    k = c("c_custkey")
    forms = (F.to_json(F.array("c_name", "c_mktsegment")), F.to_json(F.struct(c("c_mktsegment").alias("b"), k.alias("a"))), F.concat(F.lit('"'), "c_name", F.lit('"')), k.cast("string"))
    value = F.lit(None).cast("string")
    for n, form in enumerate(forms):
        value = F.when(F.pmod(k, F.lit(5)) == n, form).otherwise(value)
    return A.table(spark, sf_dir, "customer").select(k.alias("id"), N.value_text(value).alias("text"))


def crm_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _exported(spark, sf_dir)
    one, other = X.crm_rows(rows, "hubspot"), X.crm_rows(rows, "salesforce")
    made = one.select("Email", "First Name", "Last Name", c("Company name").alias("company")).withColumn("layout", F.lit("hubspot")).unionByName(other.select("Email", "First Name", "Last Name", c("Account Name").alias("company")).withColumn("layout", F.lit("salesforce")))
    return made.select(c("Email").alias("email"), c("First Name").alias("first_name"), c("Last Name").alias("last_name"), "company", "layout")


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders")
    seen = A.table(spark, sf_dir, "lineitem").select((c("l_orderkey") + 1).alias("entity_id"), pick(("current_title", "email", "phone", "linkedin_id"), c("l_linenumber")).alias("field"), c("l_partkey").cast("string").alias("value"), c("l_shipdate").alias("retrieved_at"), (c("l_partkey") * 10 + c("l_linenumber")).alias("id"))
    people = o.select((c("o_orderkey") + 1).alias("person_id"), F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.concat(F.lit("p"), "o_orderkey")).alias("profile_id"))
    profiles = A.table(spark, sf_dir, "customer").where("pmod(c_custkey, 3) = 0").select(c("c_custkey").alias("company_id"), F.concat(F.lit("company/"), "c_custkey").alias("linkedin_id"))
    return Y.review_leads(_exported(spark, sf_dir), people, seen, profiles)


def review_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = X.review_rows(_reviewed(spark, sf_dir).drop("rank").withColumn("rank", F.lit(0)))
    return made.select(*[c(h).alias(h.lower().replace(" ", "_")) for h in X.REVIEW])


def filtered_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reviewed(spark, sf_dir)
    return rows.where(Y.matches_review(F.lit(" C1"), F.lit("strong"), F.lit("enriched"), O.display_tier(c("tier")))).select("lead_id", "tier", "company_domain")


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _histories(spark, sf_dir)
    snapshots = h["members"].distinct().select("icp_id", "lead_id", "company_id")
    members = h["members"].withColumn("icp_version", F.pmod("lead_id", F.lit(2))).unionByName(h["members"].withColumn("icp_version", F.lit(0)))
    return Y.review_queue(members, snapshots, h["reviews"])


def newest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.latest_values(A.facts(spark, sf_dir), ("industry", "country", "employee_range"))


def review_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _histories(spark, sf_dir)
    return Y.history(h["reviews"], icp_id="F", lead_id=None).select("lead_id", "id", "decision")


def verdict_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = A.asked(spark, sf_dir).select(c("company_id").alias("lead_id"), "company_id", "person_id", "icp_id")
    rows = A.facts(spark, sf_dir).unionByName(A.person_facts(spark, sf_dir)).withColumn("id", c("id").cast("string"))
    made = Y.verdict_context(leads, rows, most=6, chars=9)
    return made.select("lead_id", F.size(F.from_json("context", "evidence array<struct<value:string>>")["evidence"]).alias("n"), F.regexp_extract("context", r'^\{"(\w+)":', 1).alias("first"),
                       F.array_join(F.array_sort(F.transform(F.from_json("context", "evidence array<struct<field:string,value:string>>")["evidence"], lambda e: F.concat_ws("=", e["field"], e["value"]))), "|").alias("told"))


def full_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a judge is told of a lead: rule results, covered terms, signals, scores, fields in conflict and missing, and evidence."""
    asked, icps = A.asked(spark, sf_dir), A.evidence_profiles(spark)
    rows, status = _with_values(spark, sf_dir)
    pair = ["icp_id", "company_id"]
    judged = Z.validate(asked, icps, rows, status).select("company_id", F.col("overall").alias("hard_rule_result"), "reasons", F.transform("results", lambda r: F.struct(r["rule"].alias("rule"), r["status"].alias("status"))).alias("rule_results"))
    terms = Z.covered_by_keywords(rows, asked, icps).select(*pair, F.col("corroborated").alias("keyword_terms"))
    fields = status.where("entity_type = 'COMPANY'").groupBy(F.col("entity_id").alias("company_id")).agg(
        F.array_sort(F.collect_list(F.when(c("status") == "CONFLICT", c("field")))).alias("conflicting_fields"), F.array_sort(F.collect_set("field")).alias("__seen")
    )
    fields = fields.select("company_id", "conflicting_fields", F.array_except(F.array(*map(F.lit, E.COMPANY_CRITICAL)), "__seen").alias("missing_fields"))
    bought = A.table(spark, sf_dir, "orders").groupBy(c("o_custkey").cast("string").alias("company_id")).agg(F.struct(F.max("o_totalprice").alias("commercial_score"), F.count("*").alias("n_orders")).alias("scores"), F.array_sort(F.collect_set("o_orderpriority")).alias("signals"))
    leads = asked.select(c("company_id").alias("lead_id"), "company_id", "person_id", "icp_id").join(judged, "company_id").join(terms, pair, "left").join(fields, "company_id", "left").join(bought, "company_id", "left")
    made = Y.verdict_context(leads, rows.withColumn("id", c("id").cast("string")))
    kind = "hard_rule_result string, reasons array<string>, rule_results array<struct<rule:string,status:string>>, keyword_terms array<string>, conflicting_fields array<string>, missing_fields array<string>, scores struct<commercial_score:double,n_orders:long>, signals array<string>, evidence array<struct<field:string>>"
    told = made.select("lead_id", F.from_json("context", kind).alias("x"))
    return told.select(
        "lead_id", "x.hard_rule_result", F.array_join("x.reasons", ",").alias("reasons"), F.size("x.rule_results").alias("n_rules"), F.array_join("x.keyword_terms", ",").alias("keyword_terms"), F.array_join("x.conflicting_fields", ",").alias("conflicting_fields"),
        F.array_join("x.missing_fields", ",").alias("missing_fields"), "x.scores.n_orders", F.array_join("x.signals", ",").alias("signals"), F.size("x.evidence").alias("n_evidence"),
    )


def feedback_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, cust = A.table(spark, sf_dir, "orders"), A.table(spark, sf_dir, "customer")
    given = o.select((c("o_orderkey") + 5).alias("lead_ref"), c("o_orderstatus").alias("icp_id"), pick(W.DECISIONS, c("o_orderkey")).alias("decision"), F.array(F.lit("A")).alias("reason_codes"))
    leads = o.select(c("o_orderkey").alias("lead_id"), c("o_custkey").alias("company_id"))
    hard = o.groupBy(c("o_orderstatus").alias("icp_id"), c("o_custkey").alias("company_id")).agg(F.max(pick(("FAIL", "HOLD", "PASS"), c("o_orderkey"))).alias("overall"))
    models = cust.select(c("c_custkey").alias("company_id"), pick(("DTC", "HYBRID", "UNKNOWN"), c("c_custkey")).alias("primary"), F.when(F.pmod("c_custkey", F.lit(3)) == 1, F.array(F.lit("B2B"), F.lit("DTC"))).otherwise(F.array(F.lit("DTC"))).alias("models"), pick(("CLASSIFIED", "CLASSIFIED", "INSUFFICIENT_EVIDENCE"), c("c_custkey")).alias("status"))
    signals = A.table(spark, sf_dir, "nation").select(c("n_name").alias("signal"), pick(("SUPPORTED", "CONFLICT"), c("n_nationkey")).alias("status"), c("n_nationkey")).join(cust.select(c("c_custkey").alias("company_id"), c("c_nationkey")), c("n_nationkey") == c("c_nationkey")).select("company_id", "signal", "status")
    return W.observations(given, leads, hard, models, signals).select("lead_ref", "icp_id", "decision", text_list("signals"))


def provider_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").select(c("l_returnflag").alias("signal"), F.array(F.concat(F.lit("p"), "l_suppkey"), F.concat(F.lit("q"), F.pmod("l_suppkey", F.lit(3)))).alias("providers"))
    return W.provider_signals(rows).select("provider", text_list("signals"))


ALL = (
    comparison_keys, fact_status, all_fields, lead_fields, supported_values, conflicting_facts, supporting_evidence, verified_fields, field_freshness, split_seen, streamed_status, company_evidence, person_evidence, fact_evidence, discovery_matches, corroborated_terms, unprovable_industries,
    described_terms, validated_leads, cited_rows, profile_errors, canonical_profiles, projected_filters, extracted_filters, filter_spans, merged_strategies, size_buckets, directory_results, resolved_homepages, vendor_facts, vendor_records, profile_ids, branch_sightings,
    allowed_sources, mock_entities, reopened_items, new_memberships, linked_repeats, run_summary, lead_statuses, stage_tallies, applied_matches, match_conflicts, applied_person_matches, assembled_signals, snapshot_as_of, value_texts, stored_tables, json_export, exported_leads, crm_leads, review_table, filtered_reviews, review_queue,
    newest_values, review_history, verdict_contexts, full_contexts, feedback_observations, provider_signals,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


