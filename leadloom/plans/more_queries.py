"""Queries of entity resolution, signals, scores, verdicts, tuning and pages, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities as N
from ..operators import evidence as E
from ..operators import pages as W
from ..operators import provenance as O
from ..operators import ranking as R
from ..operators import rules as P
from ..operators import scores as C
from ..operators import signals as G
from ..operators import tuning as U
from ..operators import verdicts as V
from . import adapters as A

c = F.col
# What an event's text says, by its number; the SQL below says which model and signal each one names.
TEXTS = (
    "A B2B marketplace", "an online store for tea", "no online store, retail only", "Direct-to-Consumer soap", "Consulting and influencer campaigns",
    "plain words", "subscription-based, raised funding", "not a subscription", "wholesale distributor", "a consumer brand",
)
FIELD = ("products_services", "business_model", "company_type", "industry")


def _pick(values: tuple[str, ...], by: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(by, F.lit(len(values))).cast("int"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    return e.select(c("user_id").alias("company_id"), _pick(FIELD, c("event_id")).alias("field"), _pick(TEXTS, F.floor(c("event_id") / 4)).alias("text"), F.lit("LOW").alias("confidence"),
                    F.concat(F.lit("p"), F.pmod("event_id", F.lit(3))).alias("provider"), c("ts").alias("retrieved_at"), c("event_id").alias("id"))


def resolve_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as sightings of their part's maker, suppliers as known companies."""
    line, part, sup = (A.table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    rows = line.join(part, c("l_partkey") == c("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("candidate_id"), F.concat(F.lit("p"), F.pmod("l_linenumber", F.lit(3))).alias("provider_id"), F.concat_ws("/", "l_partkey", F.pmod("l_suppkey", F.lit(4))).alias("external_id"),
        F.concat("p_name", F.lit(" Inc.")).alias("name"), F.when(F.pmod("l_orderkey", F.lit(2)) == 0, F.concat(F.lit("https://www.s"), "l_suppkey", F.lit("-"), F.pmod("l_partkey", F.lit(50)), F.lit(".com/"))).alias("domain"), c("l_shipdate").alias("discovered_at"),
    )
    known = sup.select(c("s_suppkey").alias("company_id"), c("s_name").alias("name"), F.concat(F.lit("s"), "s_suppkey", F.lit("-7.com")).alias("domain"), F.array().cast("array<string>").alias("aliases"), F.create_map(F.lit("p1"), F.concat_ws("/", "s_suppkey", F.lit("1"))).alias("provider_ids"))
    return N.resolve_companies(rows, known)


def resolve_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as sightings of a person at their part's maker, customers as known people."""
    line, cust = A.table(spark, sf_dir, "lineitem"), A.table(spark, sf_dir, "customer")
    k = c("l_orderkey")
    rows = line.select(
        F.concat_ws("-", k, "l_linenumber").alias("candidate_id"), F.concat(F.lit("p"), F.pmod("l_linenumber", F.lit(3))).alias("provider_id"), F.concat_ws("/", "l_partkey", F.pmod("l_suppkey", F.lit(5))).alias("external_id"),
        F.concat(F.lit("Ann Lee "), F.pmod("l_partkey", F.lit(700))).alias("name"), F.when(F.pmod(k, F.lit(3)) == 0, F.concat_ws("-", F.lit("l"), "l_suppkey", F.pmod(k, F.lit(40)))).alias("profile_id"), c("l_suppkey").alias("company_id"), c("l_shipdate").alias("discovered_at"),
    )
    known = cust.select(c("c_custkey").alias("person_id"), F.concat(F.lit("ann lee "), F.pmod("c_custkey", F.lit(900))).alias("name"), F.array().cast("array<string>").alias("aliases"), F.concat_ws("-", F.lit("l"), "c_custkey", F.lit("9")).alias("profile_id"),
                        c("c_nationkey").cast("string").alias("company_id"), F.array(c("c_nationkey").cast("string")).alias("companies"), F.create_map(F.lit("p2"), F.concat_ws("/", "c_custkey", F.lit("3"))).alias("provider_ids"))
    return N.resolve_people(rows, known)


def new_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array("l_returnflag").alias("a"), F.array("l_linestatus").alias("b"))
    return O.new_provenance(rows.where("l_linenumber >= 4"), rows.where("l_linenumber < 4"), ["l_partkey"], ["a", "b"]).select("l_orderkey", "l_linenumber")


def headline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.lead_signals(spark, sf_dir).groupBy("icp_id", O.display_tier(R.tier()).alias("ui_tier")).agg(F.count("*").alias("n"))


def headline_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.headline(A.lead_signals(spark, sf_dir).withColumns({"tier": R.tier(), "company_id": F.pmod("lead_id", F.lit(97))}), "icp_id")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = V.outcome(c("batch_outcome") == "DUPLICATE", F.pmod("lead_id", F.lit(2)) == 0, c("hard_rule_result"), c("qualification_decision"))
    return A.lead_signals(spark, sf_dir).withColumn("outcome", made)


def quality_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir).withColumns({"feedback": F.when(F.pmod("lead_id", F.lit(5)) < 3, _pick(V.DECISIONS, c("lead_id"))), "completeness": F.pmod("lead_id", F.lit(10)) / 9})
    made = O.quality_figures(rows, "icp_id")
    return made.select("icp_id", *[F.round(x, 6).alias(x) for x in made.columns[1:]])


def reason_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = R.tier_reasons()
    rows = A.lead_signals(spark, sf_dir).withColumns({"company_quality_score": c("final_score"), "evidence_has_conflicts": F.pmod("lead_id", F.lit(3)) == 0, "verification_unresolved": F.lit(None).cast("boolean")})
    one = rows.select("lead_id", F.explode(codes).alias("code"))
    return one.groupBy("code", O.reason_label(c("code")).alias("label"), O.reason_sentiment(c("code")).alias("sentiment")).agg(F.count("*").alias("n"))


def business_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.business_models(_texts(spark, sf_dir)).withColumn("models", F.array_join("models", ","))


def commercial_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.commercial_signals(_texts(spark, sf_dir)).select("company_id", "signal", "status", "confidence", "n_positive", "n", F.array_join("providers", ",").alias("providers"))


def model_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.model_mentions(_texts(spark, sf_dir))


def signal_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.signal_mentions(_texts(spark, sf_dir))


def commercial_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    wanted = texts.select("company_id").distinct().select(F.lit("i").alias("icp_id"), "company_id", F.array(F.lit("retail"), F.lit("E-commerce?"), F.lit("Funding"), F.lit("consumer brand")).alias("terms"))
    return C.commercial_score(wanted, G.business_models(texts), G.commercial_signals(texts)).select("company_id", F.round("commercial_score", 6).alias("commercial_score"))


def _scored_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("c_custkey")
    return A.table(spark, sf_dir, "customer").select(k.alias("lead_id"), k.cast("string").alias("company_id"), F.when(F.pmod(k, F.lit(4)) == 0, F.concat(F.lit("q"), k)).alias("person_id"))


def evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as leads, with or without a person, by the evidence of their orders."""
    status = E.field_status(A.facts(spark, sf_dir).unionByName(A.person_facts(spark, sf_dir)))
    models = A.table(spark, sf_dir, "customer").where("pmod(c_custkey, 3) > 0").select(c("c_custkey").cast("string").alias("company_id"), F.when(F.pmod("c_custkey", F.lit(3)) == 1, "CLASSIFIED").otherwise("INSUFFICIENT_EVIDENCE").alias("status"))
    signals = A.table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(c("c_custkey").cast("string").alias("company_id"))
    return C.evidence_score(_scored_leads(spark, sf_dir), status, models, signals).select("lead_id", F.round("evidence_score", 6).alias("evidence_score"))


def icp_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = P.evaluate(A.candidates(spark, sf_dir), A.icps(spark))
    return done.select("candidate_id", F.round(C.icp_score(c("results")), 6).alias("icp_score"), F.concat_ws(",", U.verification_fields(c("results"))).alias("to_verify"))


def company_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = P.evaluate(A.candidates(spark, sf_dir), A.icps(spark))
    k = c("candidate_id")
    made = C.quality(c("results"), c("overall"), C.icp_score(c("results")), F.pmod(k, F.lit(101)).cast("double"), _pick(("structured", "keyword_fallback", "unknown"), k), F.pmod(k, F.lit(13)),
                     F.when(F.pmod(k, F.lit(5)) < 4, _pick(V.DECISIONS, k)), F.pmod(k, F.lit(90)).cast("double"))
    return done.select("candidate_id", F.round(made["score"], 6).alias("score"), made["label"].alias("label"))


def identity_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").select(c("l_orderkey"), (c("l_quantity") > 48).alias("has_conflict"), F.when(c("l_tax") > 0.07, "HIGH").alias("confidence"), F.when(c("l_discount") > 0.08, "NEW").otherwise("MATCH").alias("status"))
    return C.identity_confidence(rows, "l_orderkey")


def lead_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as leads; what was told of their own lines, and of lines of the order of a third of the number."""
    rows = identity_confidence(spark, sf_dir)
    leads = A.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("lead_id"), c("o_orderkey").alias("company_id"), F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.floor(c("o_orderkey") / 3)).alias("person_id"))
    named = lambda key: rows.select(c("l_orderkey").alias(key), "identity_confidence")
    return C.mean_identity(leads, named("company_id").where("pmod(company_id, 5) > 0"), named("person_id"))


def final_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("o_orderkey")
    part = lambda m: F.pmod(k, F.lit(m)).cast("double")
    score = C.final_score(_pick(("PASS", "FAIL", "PASS", "HOLD", "PASS"), k), part(101), F.when(F.pmod(k, F.lit(50)) != 7, part(97)), part(89), part(83), F.when(F.pmod(k, F.lit(3)) != 0, part(79)))
    return A.table(spark, sf_dir, "orders").select(k, F.round(score, 6).alias("final_score"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("o_orderkey")
    body = F.concat(
        F.lit('{"decision": "'), _pick((*V.DECISIONS, "MAYBE"), k), F.lit('", "confidence": '), F.when(F.pmod(k, F.lit(23)) == 4, '"high"').when(F.pmod(k, F.lit(23)) == 5, "null").otherwise(F.pmod(k, F.lit(110)).cast("string")),
        F.when(F.pmod(k, F.lit(19)) == 3, "").when(F.pmod(k, F.lit(19)) == 4, ', "summary": ""').otherwise(', "summary": "fits"'), F.when(F.pmod(k, F.lit(29)) == 6, ', "mood": 1').otherwise(""),
        F.lit(', "supporting_evidence_ids": ["e'), F.pmod(k, F.lit(3)), F.lit('"], "risk_evidence_ids": []}'),
    )
    raw = F.when(F.pmod(k, F.lit(11)) == 0, " ").when(F.pmod(k, F.lit(11)) == 1, F.concat(F.lit("no json "), k)).when(F.pmod(k, F.lit(11)) == 2, "[1]").otherwise(body)
    return A.table(spark, sf_dir, "orders").select(k, V.parse(raw, F.array(F.lit("e0"), F.lit("e1"))).alias("v"))


def parse_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("o_orderkey", "v.status", "v.verdict", "v.confidence")


def prescreens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("o_orderkey")
    answer = _pick(('{"verdict": "NOT_RELEVANT", "reason": "other", "confidence": 70}', '{"verdict": "RELEVANT", "reason": "fits", "confidence": 101}', "", "{", '{"verdict": "RELEVANT", "reason": "fits", "confidence": 9}'), k)
    made = V.prescreen(F.when(F.pmod(k, F.lit(3)) == 0, "page text"), _pick(("ok", "block_page"), k), F.when(F.pmod(k, F.lit(4)) == 0, "  a snippet ").otherwise("  "), answer)
    rows = A.table(spark, sf_dir, "orders").select(k, made.alias("p"))
    return rows.select("o_orderkey", "p.status", "p.verdict", "p.content_source", V.screened_out(c("p.verdict")).alias("rejected"))


def verdict_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.lead_signals(spark, sf_dir).withColumn("g", V.gate(c("hard_rule_result"), _pick(("structured", "keyword_fallback"), c("lead_id"))))
    second = V.adversarial_gate(c("hard_rule_result"))["result"]
    return rows.groupBy(F.coalesce("g.status", F.lit("TO_BE_JUDGED")).alias("status"), c("g.decision").alias("decision"), second.alias("second")).agg(F.count("*").alias("n"))


def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = V.review(c("human_review_decision"), c("hard_rule_result"), F.array(F.lit("SEEN")))
    return A.lead_signals(spark, sf_dir).where("human_review_decision is not null").select("lead_id", made.alias("r")).select("lead_id", "r.decision", "r.status", F.array_join("r.reasons", ",").alias("reasons"), V.feedback_of_review(c("r.decision")).alias("feedback"))


def feedback_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.when(F.pmod("lead_id", F.lit(4)) == 0, F.array(F.lit(" WRONG_SIZE "))).when(F.pmod("lead_id", F.lit(4)) == 1, F.array(F.lit("bad code"))).when(F.pmod("lead_id", F.lit(4)) == 2, F.array(F.lit("A"), F.lit("A ")))
    made = V.feedback_errors(c("qualification_decision"), codes, F.when(F.pmod("lead_id", F.lit(7)) != 0, "l").otherwise(" "), F.when(F.pmod("lead_id", F.lit(9)) != 0, "r"))
    return A.lead_signals(spark, sf_dir).select("lead_id", F.array_join(made, ",").alias("errors"))


def readiness_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("lead_id")
    some = lambda m: F.when(F.pmod(k, F.lit(m)) == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    made = V.readiness(c("hard_rule_result"), F.lit(True), some(9), some(4), F.when(F.pmod(k, F.lit(10)) == 3, "UNRESOLVED"), c("qualification_decision"), c("adversarial_result"), c("human_review_decision"), F.coalesce(c("batch_outcome") == "DUPLICATE", F.lit(False)))
    return A.lead_signals(spark, sf_dir).select("lead_id", made["level"].alias("level"), F.array_join(made["reasons"], ",").alias("reasons"))


def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.within_bounds(V.batch_counts(_outcomes(spark, sf_dir), "icp_id"))


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.run_status(A.table(spark, sf_dir, "lineitem").select("l_orderkey", (c("l_returnflag") == "N").alias("ok")), "l_orderkey")


def provider_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = A.table(spark, sf_dir, "lineitem").select("l_suppkey", c("l_returnflag").alias("provider"), (c("l_linestatus") == "F").alias("ok"), c("l_quantity").cast("long").alias("n_rows"))
    return V.provider_usage(calls, ["l_suppkey"], {"A": 2.0, "N": 1.0})


def batch_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(c("l_returnflag") == "R", F.concat(F.lit("mock-"), "l_suppkey")).otherwise("real")
    items = A.table(spark, sf_dir, "lineitem").select("l_orderkey", source.alias("provider_id"), (c("l_tax") > 0.04).alias("fetched"), _pick(("SUCCESS", "SKIPPED_NO_CONTENT", "SCHEMA_INVALID"), c("l_partkey")).alias("s"), "l_suppkey")
    return V.batch_usage(items.withColumn("prescreen_status", F.when(F.pmod("l_suppkey", F.lit(4)) > 0, c("s"))), "l_orderkey")


def _nudged(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = R.rank_leads(A.lead_signals(spark, sf_dir), ["final_score"]).select("lead_id", "icp_id", "tier", "position")
    signals = A.table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("lead_id"), c("l_returnflag").alias("signal"))
    return U.preview_ranking(ranking, signals, spark.createDataFrame([("A", 1.0), ("R", -0.5)], "signal string, magnitude double"))


def preview_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nudged(spark, sf_dir).select("lead_id", "adjustment", "new_position")


def version_icps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders").join(A.table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey"))
    kept = A.table(spark, sf_dir, "nation").select(c("n_name").alias("name"), c("n_nationkey").alias("version")).unionByName(spark.createDataFrame([("building", 7)], "name string, version int"))
    return U.version_icps(o.select("o_orderkey", c("c_mktsegment").alias("name"), "o_orderdate"), kept, "o_orderdate", "o_orderkey").select("o_orderkey", "version")


def route_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_returnflag", "l_linestatus").alias("signals"))
    return U.route_providers(rows, ["A"], ["R", "O"], ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "route")


def recommendation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as recommendations, their order lines as events."""
    log = A.table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("fingerprint"), c("l_returnflag"), c("l_linestatus").alias("event"), c("l_shipdate").alias("at"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"))
    parts = A.table(spark, sf_dir, "part").select(c("p_partkey").alias("fingerprint"))
    return U.recommendation_status(parts, log.where("l_returnflag = 'A'").withColumn("event", F.lit("APPROVED")), log.where("l_returnflag = 'R'"))


def _versions_and_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as versions of a profile, order lines as events on parts, every 50th for all."""
    k = c("l_orderkey") * 10 + c("l_linenumber")
    rows = A.table(spark, sf_dir, "lineitem").select(
        c("l_partkey").cast("string").alias("fingerprint"), _pick(U.KINDS, c("l_partkey")).alias("kind"), F.when(c("l_returnflag") == "N", "APPLIED").otherwise("ROLLED_BACK").alias("event"), (c("l_suppkey") % 10).alias("icp_id"),
        F.floor(c("l_suppkey") / 10).cast("int").alias("icp_version"), (F.pmod(k, F.lit(50)) == 0).alias("is_global"), c("l_shipdate").alias("at"), k.alias("id"),
    )
    versions = A.table(spark, sf_dir, "supplier").select((c("s_suppkey") % 10).alias("icp_id"), F.floor(c("s_suppkey") / 10).cast("int").alias("icp_version"))
    return versions, rows


def configuration_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.configuration_state(*_versions_and_events(spark, sf_dir))


def effective_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = U.effective_configuration(*_versions_and_events(spark, sf_dir))
    return made.select("icp_id", "icp_version", *[F.array_join(k.lower(), ",").alias(k.lower()) for k in U.KINDS], "is_default")


def term_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_type", " ")
    terms = F.concat(words, F.array(F.lit("  Extra  term "), F.lit(" ")), F.transform(words, lambda w: F.lower(w)))
    return A.table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(U.clean_terms(terms), "|").alias("terms"), F.array_join(U.prioritized_terms(terms, F.array(F.lit("extra term")), F.slice(words, 3, 1), 2), "|").alias("kept"),
        F.array_join(F.array_sort(F.map_keys(F.map_filter(U.term_origins(F.slice(words, 1, 1), terms), lambda k, v: v == "ai"))), "|").alias("proposed"),
    )


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = W.page_text(c("html"))
    return A.table(spark, sf_dir, "pages").select("page_id", text.alias("text")).select("page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), W.page_state(c("text")).alias("state"))


def page_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge is shown of each page."""
    kept = W.page_excerpt(c("text"))
    pages = A.table(spark, sf_dir, "pages").select("page_id", W.page_text(c("html")).alias("text"))
    return pages.select("page_id", F.length(kept).alias("n_chars"), F.sha2(kept, 256).alias("excerpt_sha256"))


def page_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.concat(c("html"), _pick(("<script src='//cdn.shopify.com/x'>", "<link href=/wp-content/plugins/woocommerce>", "HTTPS://JS.HS-SCRIPTS.COM", ""), c("page_id")))
    return A.table(spark, sf_dir, "pages").select("page_id", W.platforms(marks).alias("p")).select("page_id", *[F.coalesce(f"p.{k}", F.lit("")).alias(k) for k in W.PLATFORMS])


ALL = (
    resolve_companies, resolve_people, new_provenance, headline_counts, headline_totals, quality_figures, reason_labels, business_models, commercial_signals, model_mentions, signal_mentions, commercial_scores, evidence_scores, icp_scores, company_quality, identity_confidence, lead_identity, final_scores, parse_verdicts, prescreens, verdict_gate,
    review_decisions, feedback_checks, readiness_levels, batch_outcomes, run_status, provider_usage, batch_usage, preview_ranking, version_icps, route_providers, recommendation_status,
    configuration_state, effective_configuration, term_lists, page_texts, page_excerpts, page_platforms,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


TEXT_SQL = """x AS (SELECT user_id AS company_id, event_id % 4 AS f, (event_id // 4) % 10 AS t, 'p' || (event_id % 3) AS provider FROM events),
m(t, model) AS (VALUES (0, 'B2B'), (0, 'MARKETPLACE'), (2, 'RETAIL'), (3, 'DTC'), (4, 'CONSULTANCY'), (8, 'WHOLESALE')),
g(t, signal, says) AS (VALUES (1, 'ECOMMERCE', true), (2, 'ECOMMERCE', false), (3, 'DTC', true), (4, 'INFLUENCER_MARKETING', true), (6, 'SUBSCRIPTION', true), (6, 'FUNDING', true), (7, 'SUBSCRIPTION', false), (9, 'CONSUMER_BRAND', true)),
sp AS (SELECT company_id, count(DISTINCT t) FILTER (f = 2) > 1 AS split FROM x GROUP BY 1),
mc AS (SELECT company_id, model, count(*) AS n FROM x JOIN sp USING (company_id) JOIN m USING (t) WHERE f <> 3 AND NOT (f = 2 AND split) GROUP BY 1, 2),
ml AS (SELECT company_id, list(model ORDER BY model) AS ms, max(n) AS top FROM mc GROUP BY 1),
bm AS (SELECT company_id, CASE WHEN ms IS NULL THEN 'UNKNOWN' WHEN len(ms) = 1 THEN ms[1] ELSE 'HYBRID' END AS "primary", coalesce(array_to_string(ms, ','), '') AS models,
  CASE WHEN ms IS NOT NULL THEN 'CLASSIFIED' WHEN split THEN 'CONFLICTING_EVIDENCE' ELSE 'INSUFFICIENT_EVIDENCE' END AS status, CASE WHEN ms IS NULL THEN 'UNKNOWN' WHEN top >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
  FROM sp LEFT JOIN ml USING (company_id)),
cs AS (SELECT company_id, signal, count(*) FILTER (says) AS n_positive, count(*) AS n, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers FROM x JOIN g USING (t) WHERE f <> 3 GROUP BY 1, 2),
cg AS (SELECT *, CASE WHEN n_positive BETWEEN 1 AND n - 1 THEN 'CONFLICT' WHEN n >= 2 THEN 'SUPPORTED' ELSE 'INSUFFICIENT' END AS status,
  CASE WHEN n_positive BETWEEN 1 AND n - 1 THEN 'UNKNOWN' WHEN n_positive >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM cs)"""


# Orders as evidence on customers, as the adapter gives it: the key says what two values must share to agree.
FACTS = """f AS (SELECT o_custkey::VARCHAR AS id, o_orderkey AS k, (['company_identity', 'domain', 'industry', 'industry', 'country', 'employee_count', 'employee_range', 'company_type', 'description', 'revenue_range'])[o_orderkey % 10 + 1] AS field,
  'p' || (o_orderkey % 3) AS provider, o_orderdate AS tm, (['HIGH', 'MEDIUM', 'UNKNOWN', 'UNKNOWN', 'LOW'])[(o_orderkey // 3) % 5 + 1] AS confidence, (o_orderkey // 10) % 4 AS i4, (o_orderkey // 10) % 5 AS i5, (o_orderkey // 10) % 2 AS i2, (o_orderkey // 10) % 3 AS i3,
  (o_orderkey // 20) % 3 AS told, c_name, trunc(abs(c_acctbal))::INT::VARCHAR AS emp FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT *, CASE field WHEN 'company_identity' THEN c_name WHEN 'domain' THEN 'c' || id || '.com' WHEN 'industry' THEN (['Skincare', 'BUILDING', ' beauty', 'Gift  Sets'])[i4 + 1] WHEN 'country' THEN (['usa', 'US', 'Deutschland', 'Atlantis', 'null'])[i5 + 1]
    WHEN 'employee_count' THEN emp WHEN 'employee_range' THEN (['51-200', '201-500'])[i2 + 1] WHEN 'company_type' THEN (['DTC brand', 'Agency', 'dtc  brand'])[i3 + 1]
    WHEN 'description' THEN (['A skincare and beauty label', 'Beauty for all', 'A DTC brand for skincare'])[i3 + 1] ELSE '{"max": 5, "min": 1}' END AS value,
  CASE field WHEN 'industry' THEN (['skincare', 'building', 'beauty', 'gift sets'])[i4 + 1] WHEN 'country' THEN (['US', 'US', 'DE', 'atlantis', 'null'])[i5 + 1] WHEN 'company_type' THEN (['dtc brand', 'agency', 'dtc brand'])[i3 + 1]
    WHEN 'employee_range' THEN i2::VARCHAR WHEN 'description' THEN i3::VARCHAR ELSE '' END AS key FROM f),
st AS (SELECT id, field, CASE WHEN count(DISTINCT key) > 1 THEN 'CONFLICT' WHEN count(*) >= 2 OR max(confidence) IN ('MEDIUM', 'HIGH') THEN 'SUPPORTED' ELSE 'INSUFFICIENT' END AS status, count(*) AS n, count(DISTINCT provider) > 1 AS backed,
  max(tm) AS newest, arg_min(value, (tm, k)) AS value, arg_min(key, (tm, k)) AS key FROM w GROUP BY 1, 2)"""
PEOPLE = """pw AS (SELECT 'q' || l_partkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'company_association' ELSE 'current_title' END AS field, CASE WHEN l_linenumber % 2 = 0 THEN (l_partkey % 150)::VARCHAR ELSE (['VP of Sales', 'CEO'])[l_partkey % 2 + 1] END AS value,
  'p' || (l_suppkey % 3) AS provider FROM lineitem),
ps AS (SELECT id, field, CASE WHEN count(*) >= 2 THEN 'SUPPORTED' ELSE 'INSUFFICIENT' END AS status, count(DISTINCT provider) > 1 AS backed, any_value(value) AS value FROM pw GROUP BY 1, 2)"""


def oracle_sql(signals: str, rules: str, status: str, tiers: str) -> dict[str, str]:
    order_id = "l_orderkey * 10 + l_linenumber"
    rule_list = "list_filter([r3, r2, r1, r4, r6, r7], lambda r: r <> 'NA')"
    return {
        "business_models": f"WITH {TEXT_SQL} SELECT * FROM bm",
        "commercial_signals": f"WITH {TEXT_SQL} SELECT company_id, signal, status, confidence, n_positive, n, providers FROM cg",
        "model_mentions": f"""WITH {TEXT_SQL}, y AS (SELECT user_id AS company_id, event_id AS id, event_id % 4 AS f, (event_id // 4) % 10 AS t FROM events WHERE event_id % 4 <> 3),
            n(t, model, phrase) AS (VALUES (0, 'B2B', 'b2b'), (0, 'MARKETPLACE', 'marketplace'), (2, 'RETAIL', 'retail'), (3, 'DTC', 'direct-to-consumer'), (4, 'CONSULTANCY', 'consulting'), (8, 'WHOLESALE', 'wholesale'))
            SELECT company_id, model, id, phrase FROM y JOIN sp USING (company_id) JOIN n USING (t) WHERE NOT (f = 2 AND split) UNION ALL SELECT company_id, NULL, id, NULL FROM y JOIN sp USING (company_id) WHERE f = 2 AND split""",
        "signal_mentions": """WITH n(t, signal, says, phrase) AS (VALUES (1, 'ECOMMERCE', true, 'online store'), (2, 'ECOMMERCE', false, 'no online store'), (3, 'DTC', true, 'direct-to-consumer'), (4, 'INFLUENCER_MARKETING', true, 'influencer campaigns'), (6, 'SUBSCRIPTION', true, 'subscription-based'),
              (6, 'FUNDING', true, 'raised funding'), (7, 'SUBSCRIPTION', false, 'not a subscription'), (9, 'CONSUMER_BRAND', true, 'consumer brand'))
            SELECT user_id AS company_id, event_id AS id, signal, says, phrase FROM events JOIN n ON t = (event_id // 4) % 10 WHERE event_id % 4 <> 3""",
        "commercial_scores": f"""WITH {TEXT_SQL}, p AS (SELECT company_id, unnest([
              CASE bm.status WHEN 'CLASSIFIED' THEN CASE WHEN list_contains(string_split(models, ','), 'RETAIL') THEN 100 ELSE 0 END WHEN 'CONFLICTING_EVIDENCE' THEN 20 ELSE 0 END,
              (SELECT coalesce(max(CASE status WHEN 'SUPPORTED' THEN 100 WHEN 'INSUFFICIENT' THEN 55 ELSE 20 END), 0) FROM cg WHERE cg.company_id = bm.company_id AND signal = 'FUNDING'),
              (SELECT coalesce(max(CASE status WHEN 'SUPPORTED' THEN 100 WHEN 'INSUFFICIENT' THEN 55 ELSE 20 END), 0) FROM cg WHERE cg.company_id = bm.company_id AND signal = 'CONSUMER_BRAND')]) AS v FROM bm)
            SELECT company_id, round(avg(v), 6) AS commercial_score FROM p GROUP BY 1""",
        "evidence_scores": f"""WITH {FACTS}, {PEOPLE}, a AS (SELECT id, field, status, backed FROM st UNION ALL SELECT id, field, status, backed FROM ps),
            l AS (SELECT c_custkey AS lead_id, c_custkey::VARCHAR AS c, CASE WHEN c_custkey % 4 = 0 THEN 'q' || c_custkey END AS p, c_custkey, c_acctbal FROM customer),
            s AS (SELECT lead_id, any_value(p) AS p, any_value(c_custkey) AS k, any_value(c_acctbal) AS bal, count(a.field) AS n, count(*) FILTER (status <> 'CONFLICT') AS ok, count(*) FILTER (backed) AS bk,
              count(*) FILTER (a.id = c AND field IN ('company_identity', 'domain', 'industry', 'employee_range', 'country', 'company_type', 'business_model', 'linkedin_id', 'revenue_range')) AS cc,
              count(*) FILTER (a.id = p AND field IN ('person_identity', 'current_title', 'company_association', 'linkedin_id')) AS cp, count(*) FILTER (field IN ('company_identity', 'domain', 'person_identity')) AS kn FROM l LEFT JOIN a ON a.id = c OR a.id = p GROUP BY 1)
            SELECT lead_id, round(((CASE WHEN p IS NULL THEN 100.0 * cc / 9 ELSE (100.0 * cc / 9 + 100.0 * cp / 4) / 2 END + CASE WHEN n = 0 THEN 100 ELSE 100.0 * ok / n END + CASE WHEN n = 0 THEN 0 ELSE 100.0 * bk / n END
              + CASE WHEN kn > 0 THEN 100 ELSE 0 END + ([0, 100, 30])[k % 3 + 1] + CASE WHEN bal > 5000 THEN 100 ELSE 0 END) / 6)::DOUBLE, 6) AS evidence_score FROM s""",
        "icp_scores": f"""WITH {rules} SELECT id AS candidate_id, round(CASE WHEN len({rule_list}) = 0 THEN 100.0 ELSE 100.0 * len(list_filter({rule_list}, lambda r: r = 'PASS')) / len({rule_list}) END::DOUBLE, 6) AS icp_score,
            array_to_string(list_filter([CASE WHEN r3 = 'HOLD' THEN 'employee_range' END, CASE WHEN r2 = 'HOLD' THEN 'geography' END, CASE WHEN r7 = 'HOLD' THEN 'custom_rule:sells online' END], lambda r: r IS NOT NULL)[1:2], ',') AS to_verify FROM x""",
        "company_quality": f"""WITH {rules}, k AS (SELECT *, CASE WHEN 'FAIL' IN (r1, r2, r3, r4, r6, r7) THEN 'FAIL' WHEN 'HOLD' IN (r1, r2, r3, r4, r6, r7) THEN 'HOLD' ELSE 'PASS' END AS overall,
              CASE WHEN id % 5 < 4 THEN (['GOOD_FIT', 'WEAK_FIT', 'NOT_FIT', 'HOLD'])[id % 4 + 1] END AS dec, id % 90 AS sure FROM x),
            w AS (SELECT id, overall, [(0.4, CASE WHEN len({rule_list}) = 0 THEN 100.0 ELSE 100.0 * len(list_filter({rule_list}, lambda r: r = 'PASS')) / len({rule_list}) END), (0.1, ([90.0, 45.0, 50.0])[id % 3 + 1]), (0.2, least(id % 101, 100)::DOUBLE),
              (0.1, CASE r3 WHEN 'PASS' THEN 100.0 WHEN 'HOLD' THEN 50.0 WHEN 'FAIL' THEN 0.0 END), (0.1, CASE r2 WHEN 'PASS' THEN 100.0 WHEN 'HOLD' THEN 50.0 WHEN 'FAIL' THEN 0.0 END),
              (0.15, CASE dec WHEN 'GOOD_FIT' THEN least(100, 60 + 0.4 * sure) WHEN 'WEAK_FIT' THEN 30 + 0.3 * sure WHEN 'HOLD' THEN 50.0 WHEN 'NOT_FIT' THEN greatest(0, 20 - 0.2 * sure) END), (0.1, 10.0 * least(id % 13, 10))] AS v FROM k),
            u AS (SELECT id, overall, unnest(v) AS p FROM w), t AS (SELECT id, any_value(overall) AS overall, sum(p[1] * p[2]::DOUBLE) FILTER (p[2] IS NOT NULL) / sum(p[1]) FILTER (p[2] IS NOT NULL) AS s FROM u GROUP BY 1)
            SELECT id AS candidate_id, CASE WHEN overall <> 'FAIL' THEN round(s::DOUBLE, 6) END AS score, CASE WHEN overall = 'FAIL' THEN 'REJECT' WHEN overall = 'PASS' AND s >= 70 THEN 'STRONG' ELSE 'REVIEW' END AS label FROM t""",
        "identity_confidence": """SELECT l_orderkey, CASE WHEN bool_or(l_quantity > 48) THEN 40.0 WHEN bool_or(l_tax > 0.07) THEN 100.0 WHEN bool_or(l_discount > 0.08) THEN 75.0 ELSE 50.0 END::DOUBLE AS identity_confidence FROM lineitem GROUP BY 1""",
        "lead_identity": """WITH t AS (SELECT l_orderkey AS k, CASE WHEN bool_or(l_quantity > 48) THEN 40.0 WHEN bool_or(l_tax > 0.07) THEN 100.0 WHEN bool_or(l_discount > 0.08) THEN 75.0 ELSE 50.0 END AS s FROM lineitem GROUP BY 1)
            SELECT o_orderkey AS lead_id, CASE WHEN a.s IS NULL AND b.s IS NULL THEN 50.0 WHEN a.s IS NULL THEN b.s WHEN b.s IS NULL THEN a.s ELSE (a.s + b.s) / 2 END::DOUBLE AS identity_confidence
            FROM orders LEFT JOIN t a ON a.k = o_orderkey AND o_orderkey % 5 > 0 LEFT JOIN t b ON o_orderkey % 3 = 0 AND b.k = o_orderkey // 3""",
        "final_scores": """WITH k AS (SELECT o_orderkey, 0.4 * (o_orderkey % 101) + 0.3 * (o_orderkey % 97) + 0.15 * (o_orderkey % 89) + 0.05 * (o_orderkey % 83) AS s FROM orders)
            SELECT o_orderkey, CASE WHEN o_orderkey % 5 NOT IN (1, 3) AND o_orderkey % 50 <> 7 THEN round(CASE WHEN o_orderkey % 3 = 0 THEN s / 0.9 ELSE s + 0.1 * (o_orderkey % 79) END::DOUBLE, 6) END AS final_score FROM k""",
        "parse_verdicts": """WITH k AS (SELECT o_orderkey AS o, o_orderkey % 5 AS d, o_orderkey % 110 AS conf FROM orders), j AS (SELECT *, CASE o % 11 WHEN 0 THEN 'EMPTY_RESPONSE' WHEN 1 THEN 'MALFORMED_OUTPUT' WHEN 2 THEN 'SCHEMA_INVALID' ELSE
              CASE WHEN d = 4 OR conf > 100 OR o % 23 IN (4, 5) OR o % 19 IN (3, 4) OR o % 29 = 6 THEN 'SCHEMA_INVALID' WHEN o % 3 = 2 THEN 'INVALID_EVIDENCE_IDS' ELSE 'SUCCESS' END END AS status FROM k)
            SELECT o AS o_orderkey, status, CASE WHEN status = 'SUCCESS' THEN (['GOOD_FIT', 'WEAK_FIT', 'NOT_FIT', 'HOLD'])[d + 1] END AS verdict, CASE WHEN status = 'SUCCESS' THEN conf::DOUBLE END AS confidence FROM j""",
        "prescreens": """WITH k AS (SELECT o_orderkey AS o, CASE WHEN o_orderkey % 6 = 0 THEN 'homepage' WHEN o_orderkey % 4 = 0 THEN 'search_snippet' ELSE 'none' END AS src, o_orderkey % 5 AS a FROM orders),
            j AS (SELECT *, CASE WHEN src = 'none' THEN 'SKIPPED_NO_CONTENT' ELSE (['SUCCESS', 'SCHEMA_INVALID', 'PROVIDER_UNAVAILABLE', 'MALFORMED_OUTPUT', 'SUCCESS'])[a + 1] END AS status FROM k)
            SELECT o AS o_orderkey, status, CASE WHEN status = 'SUCCESS' THEN CASE a WHEN 0 THEN 'NOT_RELEVANT' ELSE 'RELEVANT' END END AS verdict, src AS content_source, status = 'SUCCESS' AND a = 0 AS rejected FROM j""",
        "verdict_gate": f"""WITH {signals}, k AS (SELECT CASE WHEN hard = 'FAIL' THEN 'HARD_REJECTED' WHEN hard = 'HOLD' THEN 'HARD_HOLD' WHEN k % 2 = 0 THEN 'STRUCTURED_MATCH_TRUSTED' ELSE 'TO_BE_JUDGED' END AS status, CASE WHEN hard IN ('FAIL', 'HOLD') THEN 'NOT_EXECUTED' END AS second FROM o)
            SELECT second, status, CASE status WHEN 'HARD_REJECTED' THEN 'REJECT' WHEN 'HARD_HOLD' THEN 'HOLD' WHEN 'STRUCTURED_MATCH_TRUSTED' THEN 'GOOD_FIT' END AS decision, count(*) AS n FROM k GROUP BY 1, 2, 3""",
        "review_decisions": f"""WITH {signals} SELECT k AS lead_id, CASE WHEN human = 'ACCEPT' AND hard = 'FAIL' THEN 'REJECT' ELSE human END AS decision, CASE WHEN human = 'ACCEPT' AND hard = 'FAIL' THEN 'BLOCKED_BY_HARD_FAIL' ELSE 'RECORDED' END AS status,
            CASE WHEN human = 'ACCEPT' AND hard = 'FAIL' THEN 'SEEN,HARD_ICP_FAILURE' ELSE 'SEEN' END AS reasons,
            CASE WHEN human = 'REJECT' OR (human = 'ACCEPT' AND hard = 'FAIL') THEN 'NOT_FIT' WHEN human = 'ACCEPT' THEN 'GOOD_FIT' ELSE 'HOLD' END AS feedback FROM o WHERE human IS NOT NULL""",
        "feedback_checks": f"""WITH {signals} SELECT k AS lead_id, concat_ws(',', CASE WHEN k % 7 = 0 THEN 'LEAD_REF_BLANK' END, CASE WHEN k % 9 = 0 THEN 'REVIEWER_BLANK' END,
            CASE k % 4 WHEN 1 THEN 'REASON_CODE_FORM' WHEN 2 THEN 'REASON_CODE_REPEATED' WHEN 3 THEN CASE WHEN fit <> 'GOOD_FIT' THEN 'REASON_CODE_MISSING' END END) AS errors FROM o""",
        "readiness_levels": f"""WITH {signals} SELECT k AS lead_id, CASE WHEN k % 9 = 0 THEN 'CONFLICTED' WHEN hard <> 'PASS' THEN 'INSUFFICIENT_EVIDENCE' WHEN k % 4 = 0 OR k % 10 = 3 THEN 'PARTIALLY_VERIFIED' ELSE 'VERIFIED' END AS level,
            concat_ws(',', CASE WHEN k % 9 = 0 THEN 'EVIDENCE_CONFLICTS_PRESENT' ELSE 'HARD_RULE_' || hard END, CASE WHEN k % 9 <> 0 AND hard = 'PASS' THEN CASE WHEN k % 4 = 0 THEN 'CRITICAL_FIELDS_MISSING' ELSE 'CRITICAL_FIELDS_FULLY_SUPPORTED' END END,
            CASE WHEN k % 9 <> 0 AND hard = 'PASS' AND k % 4 <> 0 AND k % 10 = 3 THEN 'VERIFICATION_UNRESOLVED' END, CASE WHEN (fit = 'GOOD_FIT' AND adv IN ('DISPROVED', 'WEAKENED')) OR (fit = 'NOT_FIT' AND adv = 'SURVIVES') THEN 'QUALIFICATION_ADVERSARIAL_DISAGREEMENT' END,
            CASE human WHEN 'ACCEPT' THEN 'HUMAN_ACCEPTED' WHEN 'REJECT' THEN 'HUMAN_REJECTED' END, CASE WHEN outcome = 'DUPLICATE' THEN 'DUPLICATE_OCCURRENCE' END) AS reasons FROM o""",
        "batch_outcomes": f"""WITH {signals}, k AS (SELECT *, CASE WHEN outcome = 'DUPLICATE' AND k % 2 <> 0 THEN 'D' WHEN hard = 'FAIL' THEN 'R' WHEN hard = 'HOLD' THEN 'H' WHEN fit IN ('GOOD_FIT', 'WEAK_FIT') THEN 'A' WHEN fit = 'NOT_FIT' THEN 'R' ELSE 'H' END AS b FROM o)
            SELECT icp_id, count(*) AS n_items, count(*) FILTER (b = 'A') AS n_accepted, count(*) FILTER (b = 'R') AS n_rejected, count(*) FILTER (b = 'H') AS n_held, count(*) FILTER (b = 'D') AS n_duplicate, count(DISTINCT k) FILTER (b = 'A') AS n_leads, true AS consistent FROM k GROUP BY 1""",
        "run_status": "SELECT l_orderkey, CASE WHEN bool_and(l_returnflag = 'N') THEN 'COMPLETED' WHEN bool_or(l_returnflag = 'N') THEN 'PARTIAL_FAILURE' ELSE 'FAILED' END AS status FROM lineitem GROUP BY 1",
        "provider_usage": """SELECT l_suppkey, l_returnflag AS provider, count(*) AS n_calls, count(*) FILTER (l_linestatus <> 'F') AS n_failed, sum(l_quantity::BIGINT)::BIGINT AS n_rows,
            (sum(l_quantity::BIGINT) * CASE l_returnflag WHEN 'A' THEN 2.0 WHEN 'N' THEN 1.0 ELSE 0.0 END)::DOUBLE AS spend FROM lineitem GROUP BY 1, 2""",
        "preview_ranking": f"""WITH {signals}, r AS (SELECT k, icp_id, list_position({tiers}, tier) AS ti, row_number() OVER (PARTITION BY icp_id ORDER BY list_position({tiers}, tier), coalesce(score, -1) DESC, k) AS p FROM t),
            a AS (SELECT l_orderkey AS k, (max((l_returnflag = 'A')::INT) - 0.5 * max((l_returnflag = 'R')::INT))::DOUBLE AS adj FROM lineitem GROUP BY 1), j AS (SELECT r.*, coalesce(adj, 0)::DOUBLE AS adjustment FROM r LEFT JOIN a USING (k))
            SELECT k AS lead_id, adjustment, row_number() OVER (PARTITION BY icp_id ORDER BY ti, adjustment DESC, p) AS new_position FROM j""",
        "version_icps": """SELECT o_orderkey, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate, o_orderkey) + CASE WHEN c_mktsegment = 'BUILDING' THEN 7 ELSE 0 END)::INT AS version FROM orders JOIN customer ON o_custkey = c_custkey""",
        "route_providers": """SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'A' THEN -1 WHEN l_returnflag = 'R' OR l_linestatus = 'O' THEN 1 ELSE 0 END, l_linenumber) AS route FROM lineitem""",
        "recommendation_status": f"""WITH q AS (SELECT l_partkey, arg_max(l_linestatus, (l_shipdate, {order_id})) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
            SELECT p_partkey AS fingerprint, coalesce(s, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') THEN 'APPROVED' END, 'PENDING') AS status FROM part LEFT JOIN q ON p_partkey = l_partkey""",
        "batch_usage": """SELECT l_orderkey, bool_or(l_returnflag = 'R') AS used_mock, count(*) FILTER (l_tax > 0.04) AS n_fetched, count(*) FILTER (l_suppkey % 4 > 0 AND l_partkey % 3 <> 1) AS n_asked FROM lineitem GROUP BY 1""",
        "configuration_state": f"""WITH v AS (SELECT DISTINCT s_suppkey % 10 AS icp_id, (s_suppkey // 10)::INT AS icp_version FROM supplier), e AS (SELECT l_partkey AS f, l_returnflag = 'N' AS on_, l_suppkey % 10 AS icp_id, (l_suppkey // 10)::INT AS icp_version, ({order_id}) % 50 = 0 AS g, l_shipdate AS tm, {order_id} AS id FROM lineitem),
            g AS (SELECT f, arg_max(on_, (tm, id)) AS was, max((tm, id)) AS top FROM e WHERE g GROUP BY 1), o AS (SELECT icp_id, icp_version, f, arg_max(on_, (tm, id)) AS now_, max((tm, id)) AS top FROM e JOIN v USING (icp_id, icp_version) WHERE NOT g GROUP BY 1, 2, 3),
            s AS (SELECT NULL AS icp_id, NULL AS icp_version, f, 'SHARED' AS effect FROM g WHERE was UNION ALL SELECT icp_id, icp_version, f, CASE WHEN now_ THEN 'ADDED' ELSE 'REMOVED' END FROM o LEFT JOIN g USING (f) WHERE (g.top IS NULL OR o.top > g.top) AND now_ <> coalesce(was, false))
            SELECT icp_id, icp_version, (['RANKING_TIE_BREAK_NUDGE', 'SOFT_PREFERENCE_WEIGHT_HINT', 'PROVIDER_PRIORITY_HINT', 'DEEPER_VERIFICATION_HINT'])[f % 4 + 1] AS kind, f::VARCHAR AS fingerprint, effect FROM s""",
        "effective_configuration": f"""WITH v AS (SELECT DISTINCT s_suppkey % 10 AS icp_id, (s_suppkey // 10)::INT AS icp_version FROM supplier), e AS (SELECT l_partkey AS f, l_returnflag = 'N' AS on_, l_suppkey % 10 AS i, (l_suppkey // 10)::INT AS ver, ({order_id}) % 50 = 0 AS g, l_shipdate AS tm, {order_id} AS id FROM lineitem),
            q AS (SELECT icp_id, icp_version, f, arg_max(on_, (tm, id)) AS on_ FROM v JOIN e ON g OR (i = icp_id AND ver = icp_version) GROUP BY 1, 2, 3),
            r AS (SELECT icp_id, icp_version, {', '.join(f"coalesce(string_agg(f::VARCHAR, ',' ORDER BY f::VARCHAR) FILTER (on_ AND f % 4 = {k}), '') AS {n}" for k, n in enumerate(('ranking_tie_break_nudge', 'soft_preference_weight_hint', 'provider_priority_hint', 'deeper_verification_hint')))} FROM q GROUP BY 1, 2)
            SELECT *, ranking_tie_break_nudge || soft_preference_weight_hint || provider_priority_hint || deeper_verification_hint = '' AS is_default FROM r""",
        "new_provenance": """SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_linenumber >= 4 AND (NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_linenumber < 4 AND s.l_partkey = l.l_partkey AND s.l_returnflag = l.l_returnflag)
            OR NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_linenumber < 4 AND s.l_partkey = l.l_partkey AND s.l_linestatus = l.l_linestatus))""",
        "headline_counts": f"""WITH {signals} SELECT icp_id, CASE WHEN tier IN ('ACCEPTED', 'QUALIFIED_STRONG') THEN 'strong' WHEN tier = 'QUALIFIED_WEAK' THEN 'good' WHEN tier = 'HARD_FAILED' THEN 'rejected' ELSE 'weak' END AS ui_tier, count(*) AS n FROM t GROUP BY 1, 2""",
        "headline_totals": f"""WITH {signals} SELECT icp_id, count(DISTINCT k % 97) AS total_found, count(*) FILTER (tier IN ('ACCEPTED', 'QUALIFIED_STRONG', 'QUALIFIED_WEAK')) AS qualified_found FROM t GROUP BY 1""",
        "quality_figures": f"""WITH {signals}, k AS (SELECT *, CASE WHEN k % 5 < 3 THEN (['GOOD_FIT', 'WEAK_FIT', 'NOT_FIT', 'HOLD'])[k % 4 + 1] END AS fb, (k % 10) / 9.0 AS full_,
              CASE WHEN outcome = 'DUPLICATE' AND k % 2 <> 0 THEN 'D' WHEN hard = 'FAIL' THEN 'R' WHEN hard = 'HOLD' THEN 'H' WHEN fit IN ('GOOD_FIT', 'WEAK_FIT') THEN 'A' WHEN fit = 'NOT_FIT' THEN 'R' ELSE 'H' END AS b FROM o)
            SELECT icp_id, round(count(*) FILTER (b = 'A' AND fb = 'GOOD_FIT') / count(*) FILTER (b = 'A'), 6) AS good_fit_precision, round(count(*) FILTER (b = 'A' AND fb = 'NOT_FIT') / count(*) FILTER (b = 'A'), 6) AS false_positive_rate,
              round((avg(full_) FILTER (b IN ('A', 'H')))::DOUBLE, 6) AS evidence_completeness, round(count(*) FILTER (b = 'D') / count(*), 6) AS duplicate_rate,
              round(count(*) FILTER (b <> 'D' AND left(human, 1) <> b) / count(*) FILTER (b <> 'D'), 6) AS override_rate FROM k GROUP BY 1""",
        "reason_labels": f"""WITH {signals}, k AS (SELECT hard, outcome, human, adv, fit, score, k % 3 = 0 AS clash FROM o),
            m AS (SELECT *, CASE WHEN hard = 'FAIL' THEN ['HARD_RULE_FAIL'] WHEN outcome = 'DUPLICATE' THEN ['HUMAN_DUPLICATE'] WHEN human = 'REJECT' THEN ['HUMAN_REJECTED'] WHEN human = 'ACCEPT' THEN ['HUMAN_ACCEPTED'] WHEN human = 'HOLD' THEN ['HUMAN_HELD']
              WHEN hard = 'HOLD' THEN ['HARD_RULE_HOLD'] WHEN adv = 'DISPROVED' THEN ['HARD_RULE_PASS', 'ADVERSARIAL_DISPROVED'] WHEN fit = 'NOT_FIT' THEN ['HARD_RULE_PASS', 'QUALIFICATION_NOT_FIT'] WHEN fit = 'HOLD' THEN ['HARD_RULE_PASS', 'QUALIFICATION_HOLD']
              ELSE ['HARD_RULE_PASS', 'QUALIFICATION_' || fit, 'ADVERSARIAL_' || coalesce(adv, 'MISSING')] END AS main FROM k),
            u AS (SELECT unnest(main) AS code FROM m UNION ALL SELECT 'SCORE_MISSING' FROM m WHERE score IS NULL AND hard = 'PASS' UNION ALL SELECT 'COMPANY_QUALITY_MISSING' FROM m WHERE score IS NULL AND hard IN ('PASS', 'HOLD') UNION ALL SELECT 'EVIDENCE_CONFLICTS_PRESENT' FROM m WHERE clash),
            l(code, label, sentiment) AS (VALUES ('HARD_RULE_FAIL', 'Fails a hard requirement', 'not_met'), ('HARD_RULE_HOLD', 'Hard requirement unresolved', 'unknown'), ('HARD_RULE_PASS', 'Meets all hard requirements', 'met'), ('HUMAN_ACCEPTED', 'Accepted by reviewer', 'met'),
              ('HUMAN_REJECTED', 'Rejected by reviewer', 'not_met'), ('HUMAN_HELD', 'Held by reviewer', 'unknown'), ('HUMAN_DUPLICATE', 'Marked duplicate by reviewer', 'not_met'), ('QUALIFICATION_GOOD_FIT', 'Strong overall fit', 'met'),
              ('QUALIFICATION_WEAK_FIT', 'Some fit, weaker signal', 'met'), ('QUALIFICATION_NOT_FIT', 'Not a fit', 'not_met'), ('QUALIFICATION_HOLD', 'Qualification held', 'unknown'), ('ADVERSARIAL_SURVIVES', 'Fit confirmed under review', 'met'),
              ('ADVERSARIAL_WEAKENED', 'Fit weakened under review', 'unknown'), ('ADVERSARIAL_DISPROVED', 'Fit disproved under review', 'not_met'), ('ADVERSARIAL_MISSING', 'Not yet adversarially reviewed', 'unknown'), ('SCORE_MISSING', 'Not yet scored', 'unknown'),
              ('EVIDENCE_CONFLICTS_PRESENT', 'Conflicting evidence present', 'not_met'), ('COMPANY_QUALITY_MISSING', 'COMPANY_QUALITY_MISSING', 'unknown'))
            SELECT code, label, sentiment, count(*) AS n FROM u JOIN l USING (code) GROUP BY 1, 2, 3""",
        "term_lists": """WITH w AS (SELECT p_partkey, string_split(p_type, ' ') AS ws FROM part)
            SELECT p_partkey, array_to_string(ws, '|') || '|Extra term' AS terms, coalesce(ws[3], ws[1]) || '|Extra term' AS kept, array_to_string(list_sort(list_append(ws[2:], 'Extra term')), '|') AS proposed FROM w""",
        "page_platforms": """SELECT page_id, (['Shopify', 'WooCommerce', '', ''])[page_id % 4 + 1] AS ecommerce_platform, (['', 'WordPress', '', ''])[page_id % 4 + 1] AS cms_platform, (['', '', 'HubSpot', ''])[page_id % 4 + 1] AS marketing_crm_platform, '' AS analytics_platform FROM pages""",
    }
