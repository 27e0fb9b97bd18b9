"""The registered queries of the prospecting operators and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import feedback as B
from ..operators import leads as L
from ..operators import ranking as R
from ..operators import rules as P
from ..sources import export as S
from . import adapters as A
from . import lead_queries as Q
from . import lead_sql
from . import more_queries as M

NOW = 1_706_745_600_000_000  # 2024-02-01 UTC, in microseconds
FIELDS = ("click", "error", "purchase", "signup")


def flagship_validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = P.evaluate(A.candidates(spark, sf_dir), A.icps(spark))
    return done.select("candidate_id", "icp_id", "overall", F.array_join("reasons", ",").alias("reasons"))


def validation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.evaluate(A.candidates(spark, sf_dir), A.icps(spark)).groupBy("icp_id", "overall").agg(F.count("*").alias("n"))


def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.get(F.array(*[F.lit(x) for x in (" Inc.", ", Ltd", " Co. LLC", "  S.A.", " foo-inc")]), F.pmod("p_partkey", F.lit(5)))
    raw = F.concat(F.lit("  "), F.col("p_name"), suffix)
    return A.table(spark, sf_dir, "part").select("p_partkey", T.normalize_company_name(raw).alias("name"), T.preference_term(F.col("p_brand")).alias("term"))


def normalize_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.get(F.array(*[F.lit(x) for x in ("Sr. VP of ", "CEO & ", "the mgr, ", "Dir. ")]), F.pmod("p_partkey", F.lit(4)))
    return A.table(spark, sf_dir, "part").select("p_partkey", T.title_key(F.concat(lead, "p_type")).alias("title"))


def normalize_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", T.normalize_domain(F.col("url")).alias("domain"))


def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.get(F.array(*[F.lit(x) for x in ("", " Jr.", " III", " Ann Lee")]), F.pmod("s_suppkey", F.lit(4)))
    name = T.split_person_name(F.concat("s_name", F.lit(" of"), end))
    return A.table(spark, sf_dir, "supplier").select("s_suppkey", name["first"].alias("first_name"), name["last"].alias("last_name"))


def evidence_field_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.field_status(A.evidence(spark, sf_dir)).select("entity_id", "field", "status", "n_rows", "corroborated")


def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = E.entity_summary(E.field_status(A.evidence(spark, sf_dir)), FIELDS)
    fresh = F.round(E.freshness_score(F.col("newest"), F.timestamp_micros(F.lit(NOW)), 1.0, 60.0), 6)
    return made.select("entity_id", F.round("completeness", 6).alias("completeness"), F.array_join("conflicting", ",").alias("conflicting"), F.array_join("missing", ",").alias("missing"), fresh.alias("freshness"))


def evidence_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.evidence(spark, sf_dir).select("entity_id", "field", "provider")
    stored = rows.where(F.pmod("entity_id", F.lit(2)) == 0).distinct()
    return E.unseen(rows, stored, ["entity_id", "field", "provider"])


def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return R.latest(rows, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


def rank_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank_leads(A.lead_signals(spark, sf_dir), ["final_score"]).select("lead_id", "icp_id", "tier", "position")


def lead_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.lead_signals(spark, sf_dir).withColumn("tier", R.tier()).groupBy("icp_id", "tier").agg(F.count("*").alias("n"))


def union_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = A.table(spark, sf_dir, "lineitem")
    parts = [line.select(F.lit(k).alias("branch"), F.col(c).alias("external_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")) for k, c in (("part", "l_partkey"), ("supplier", "l_suppkey"))]
    return L.union_sightings(parts, ["branch", "external_id"], "seq")


def deduplicate_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.pmod("l_partkey", F.lit(50)) != 0, F.col("l_partkey")).alias("company_id"),
        F.when(F.pmod("l_suppkey", F.lit(3)) != 0, F.col("l_suppkey")).alias("person_id"),
    )
    existing = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("company_id"), F.lit(None).cast("long").alias("person_id")).where(F.pmod("p_partkey", F.lit(7)) == 0)
    at = A.table(spark, sf_dir, "lineitem").where(F.pmod("l_partkey", F.lit(11)) != 0).groupBy(F.col("l_suppkey").alias("person_id")).agg(F.collect_set("l_partkey").alias("companies"))
    return L.deduplicate(rows, existing, at, "seq").groupBy("decision", "reason").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


def round_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.first_per_batch(A.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 3)


def stop_at_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("accepted"))
    return L.until_target(rows, "o_custkey", ["o_orderkey"], "accepted", 2)


def feedback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.decision_counts(A.feedback(spark, sf_dir))


def feedback_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.signal_correlation(A.feedback(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


def _recommended(rows: DataFrame) -> DataFrame:
    return rows.withColumn("fingerprint", T.fingerprint(F.lit("GLOBAL"), F.col("recommendation_type"), F.col("signal"), F.lit(None).cast("string")))


def feedback_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recommended(B.recommendations(B.signal_correlation(A.feedback(spark, sf_dir))))


def provider_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recommended(B.provider_hints(B.signal_correlation(A.feedback(spark, sf_dir))))


def reason_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.reason_frequency(A.feedback(spark, sf_dir))


def feedback_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.analysis(A.feedback(spark, sf_dir), least=50)


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.lead_signals(spark, sf_dir).select("lead_id", "hard_rule_result", "batch_outcome", (F.col("final_score") > 100).alias("high"))
    return S.export_values(rows)


ALL = (
    flagship_validations, validation_counts, normalize_names, normalize_titles, normalize_domains, split_names, evidence_field_status, evidence_summary,
    evidence_unseen, latest_order, rank_leads, lead_tiers, union_sightings, deduplicate_leads, round_cap, stop_at_target, feedback_counts, feedback_signals,
    feedback_recommendations, provider_hints, reason_frequency, feedback_analysis, export_rows,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL} | M.queries() | Q.queries()


EVIDENCE = """e AS (SELECT user_id AS entity_id, event_type AS field, (json_extract(props, '$.k')::INT % 2)::VARCHAR AS key, 'p' || (event_id % 3) AS provider,
  ts, CASE WHEN value >= 30 THEN 'HIGH' WHEN value >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM events)"""
STATUS = EVIDENCE + """, s AS (SELECT entity_id, field, CASE WHEN count(DISTINCT key) > 1 THEN 'CONFLICT' WHEN count(*) >= 2 THEN 'SUPPORTED'
  WHEN max(confidence) IN ('MEDIUM', 'HIGH') THEN 'SUPPORTED' ELSE 'INSUFFICIENT' END AS status, count(*) AS n_rows, count(DISTINCT provider) > 1 AS corroborated, max(ts) AS newest
  FROM e GROUP BY 1, 2)"""
RULES = """c AS (SELECT c_custkey AS id, c_custkey % 3 AS icp, lower(c_mktsegment) AS seg, c_nationkey % 6 AS place, c_name, CASE WHEN c_custkey % 4 <> 0 THEN trunc(abs(c_acctbal))::INT END AS emp, c_custkey % 8 = 0 AS bucket, c_custkey % 5 AS answer FROM customer),
x AS (SELECT id, icp,
  CASE icp WHEN 0 THEN CASE WHEN seg IN ('building', 'machinery') THEN 'PASS' ELSE 'FAIL' END WHEN 1 THEN 'NA' ELSE CASE WHEN seg = 'automobile' THEN 'PASS' ELSE 'FAIL' END END AS r1,
  CASE icp WHEN 0 THEN CASE WHEN place IN (0, 1) THEN 'PASS' WHEN place IN (2, 3) THEN 'FAIL' ELSE 'HOLD' END
    WHEN 1 THEN CASE WHEN place IN (2, 4) THEN 'PASS' ELSE 'HOLD' END ELSE 'NA' END AS r2,
  CASE WHEN emp IS NOT NULL THEN CASE WHEN emp >= CASE icp WHEN 0 THEN 10 WHEN 2 THEN 100 ELSE 0 END AND emp <= CASE icp WHEN 0 THEN 5000 WHEN 1 THEN 3000 ELSE 2000000000 END THEN 'PASS' ELSE 'FAIL' END
    WHEN bucket THEN 'PASS' ELSE 'HOLD' END AS r3,
  CASE icp WHEN 0 THEN 'PASS' WHEN 1 THEN 'NA' ELSE 'FAIL' END AS r4,
  CASE icp WHEN 0 THEN CASE WHEN seg = 'household' THEN 'FAIL' ELSE 'PASS' END WHEN 1 THEN 'NA' ELSE CASE WHEN seg = 'furniture' THEN 'FAIL' ELSE 'PASS' END END AS r6,
  CASE WHEN icp <> 0 THEN 'NA' WHEN answer = 0 THEN 'PASS' WHEN answer = 1 THEN 'FAIL' ELSE 'HOLD' END AS r7, emp, place FROM c),
v AS (SELECT id AS candidate_id, 'icp' || icp AS icp_id, CASE WHEN 'FAIL' IN (r1, r2, r3, r4, r6, r7) THEN 'FAIL' WHEN 'HOLD' IN (r1, r2, r3, r4, r6, r7) THEN 'HOLD' ELSE 'PASS' END AS overall,
  concat_ws(',', CASE WHEN r3 = 'FAIL' THEN CASE WHEN (icp = 0 AND emp < 10) OR (icp = 2 AND emp < 100) THEN 'EMPLOYEE_TOO_SMALL' ELSE 'EMPLOYEE_TOO_LARGE' END END, CASE WHEN r2 = 'FAIL' THEN 'WRONG_GEOGRAPHY' END,
    CASE WHEN r1 = 'FAIL' THEN 'INDUSTRY_MISMATCH' END, CASE WHEN r4 = 'FAIL' THEN 'TITLE_NOT_ALLOWED' END, CASE WHEN r6 = 'FAIL' THEN 'EXPLICIT_EXCLUSION' END, CASE WHEN r7 = 'FAIL' THEN 'CUSTOM_RULE_FAILED' END,
    CASE WHEN r3 = 'HOLD' THEN 'EMPLOYEE_COUNT_UNKNOWN' END, CASE WHEN r2 = 'HOLD' THEN CASE WHEN place = 5 THEN 'GEOGRAPHY_UNKNOWN' ELSE 'GEOGRAPHY_UNRESOLVED' END END,
    CASE WHEN r7 = 'HOLD' THEN 'CUSTOM_RULE_UNRESOLVED' END) AS reasons FROM x)"""
SIGNALS = """o AS (SELECT o_orderkey AS k, c_mktsegment AS icp_id, CASE o_orderkey % 7 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'HOLD' ELSE 'PASS' END AS hard, CASE WHEN o_orderkey % 13 = 5 THEN 'DUPLICATE' END AS outcome,
  CASE o_orderkey % 17 WHEN 1 THEN 'REJECT' WHEN 2 THEN 'ACCEPT' WHEN 3 THEN 'HOLD' END AS human, CASE o_orderkey % 5 WHEN 0 THEN 'DISPROVED' WHEN 1 THEN 'WEAKENED' WHEN 2 THEN 'SURVIVES' END AS adv,
  CASE o_orderkey % 6 WHEN 1 THEN 'WEAK_FIT' WHEN 2 THEN 'NOT_FIT' WHEN 3 THEN 'HOLD' ELSE 'GOOD_FIT' END AS fit, CASE WHEN o_orderkey % 4 <> 0 THEN floor(o_totalprice / 1000) END AS score
  FROM orders JOIN customer ON o_custkey = c_custkey),
t AS (SELECT *, CASE WHEN hard = 'FAIL' THEN 'HARD_FAILED' WHEN outcome = 'DUPLICATE' THEN 'DUPLICATE' WHEN human = 'REJECT' THEN 'REJECTED' WHEN human = 'ACCEPT' THEN 'ACCEPTED'
  WHEN human = 'HOLD' OR hard = 'HOLD' THEN 'HOLD' WHEN adv = 'DISPROVED' OR fit = 'NOT_FIT' THEN 'REJECTED' WHEN fit = 'HOLD' THEN 'HOLD'
  WHEN fit = 'GOOD_FIT' AND coalesce(adv, '') <> 'WEAKENED' THEN 'QUALIFIED_STRONG' ELSE 'QUALIFIED_WEAK' END AS tier FROM o)"""
FEEDBACK = """f AS (SELECT lang, source, n_chars, CASE WHEN toxic = 1 THEN 'NOT_FIT' WHEN quality = 1 THEN 'GOOD_FIT' ELSE 'HOLD' END AS decision FROM labels JOIN documents USING (doc_id)),
g AS (SELECT decision, unnest(['business_model:' || lang, 'commercial_signal:' || source, 'qualification_decision:' || (n_chars % 7), 'hard_rule_result:' || lang]) AS signal FROM f),
h AS (SELECT signal, count(*) FILTER (decision = 'GOOD_FIT') AS positive, count(*) FILTER (decision = 'NOT_FIT') AS negative, count(*) AS total FROM g GROUP BY 1),
k AS (SELECT *, positive / nullif(positive + negative, 0) AS rate, CASE WHEN total < 5 THEN 'INSUFFICIENT_DATA' WHEN total < 10 THEN 'LOW' WHEN total < 20 THEN 'MODERATE' ELSE 'HIGH' END AS sample FROM h),
n AS (SELECT signal, total, sample, rate > 0.5 AS up, CASE sample WHEN 'LOW' THEN 0.2 WHEN 'MODERATE' THEN 0.5 ELSE 1.0 END::DOUBLE * CASE WHEN rate > 0.5 THEN 1 ELSE -1 END AS magnitude FROM k WHERE sample <> 'INSUFFICIENT_DATA' AND abs(rate - 0.5) >= 0.15)"""
TIERS = "['ACCEPTED', 'QUALIFIED_STRONG', 'QUALIFIED_WEAK', 'HOLD', 'REJECTED', 'DUPLICATE', 'HARD_FAILED']"


def oracle_sql() -> dict[str, str]:
    return {
        "flagship_validations": f"WITH {RULES} SELECT * FROM v",
        "validation_counts": f"WITH {RULES} SELECT icp_id, overall, count(*) AS n FROM v GROUP BY 1, 2",
        "normalize_names": "SELECT p_partkey, lower(p_name) || (['', '', '', '', ' foo-inc'])[p_partkey % 5 + 1] AS name, upper(trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_')) AS term FROM part",
        "normalize_titles": """SELECT p_partkey, array_to_string(list_sort(string_split((['senior vice president', 'chief executive officer', 'manager', 'director'])[p_partkey % 4 + 1] || ' ' || lower(p_type), ' ')), ' ') AS title FROM part""",
        "normalize_domains": "SELECT page_id, regexp_extract(lower(url), '^(?:https?://)?(?:www\\.)?([^/?]*?)\\.*(?:[/?].*)?$', 1) AS domain FROM pages",
        "split_names": """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN s_name WHEN 2 THEN s_name ELSE s_name || ' of Ann' END AS first_name,
            CASE s_suppkey % 4 WHEN 0 THEN 'of' WHEN 1 THEN 'of Jr.' WHEN 2 THEN 'of III' ELSE 'Lee' END AS last_name FROM supplier""",
        "evidence_field_status": f"WITH {STATUS} SELECT entity_id, field, status, n_rows, corroborated FROM s",
        "evidence_summary": f"""WITH {STATUS}, a AS (SELECT entity_id, count(*) FILTER (field IN {FIELDS}) AS n, coalesce(string_agg(field, ',' ORDER BY field) FILTER (status = 'CONFLICT'), '') AS conflicting,
            list(field) AS seen, max(newest) AS newest FROM s GROUP BY 1), b AS (SELECT *, date_diff('microsecond', newest, TIMESTAMP '2024-02-01') / 86400000000.0 AS age FROM a)
            SELECT entity_id, round(n / 4.0, 6) AS completeness, conflicting, array_to_string(list_filter({list(FIELDS)}, lambda x: NOT list_contains(seen, x)), ',') AS missing,
            round(CASE WHEN age <= 1 THEN 100.0 WHEN age >= 60 THEN 0.0 ELSE 100.0 * (60 - age) / 59 END, 6)::DOUBLE AS freshness FROM b""",
        "evidence_unseen": f"WITH {EVIDENCE} SELECT DISTINCT entity_id, field, provider FROM e WHERE entity_id % 2 <> 0",
        "latest_order": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
        "rank_leads": f"""WITH {SIGNALS} SELECT k AS lead_id, icp_id, tier, row_number() OVER (PARTITION BY icp_id ORDER BY list_position({TIERS}, tier), coalesce(score, -1) DESC, k) AS position FROM t""",
        "lead_tiers": f"WITH {SIGNALS} SELECT icp_id, tier, count(*) AS n FROM t GROUP BY 1, 2",
        "union_sightings": "SELECT 'part' AS branch, l_partkey AS external_id, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 2 UNION ALL SELECT 'supplier', l_suppkey, min(l_orderkey * 10 + l_linenumber) FROM lineitem GROUP BY 2",
        "deduplicate_leads": """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_partkey % 50 <> 0 THEN l_partkey END AS c, CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey END AS p FROM lineitem),
            w AS (SELECT DISTINCT l_suppkey AS p, l_partkey AS c FROM lineitem WHERE l_partkey % 11 <> 0),
            u AS (SELECT *, p IS NULL OR EXISTS (SELECT 1 FROM w WHERE w.p = r.p AND w.c = r.c) AS fine FROM r),
            m AS (SELECT *, (p IS NULL AND c IN (SELECT p_partkey FROM part WHERE p_partkey % 7 = 0)) OR seq > min(seq) OVER (PARTITION BY c, p) AS held FROM u),
            d AS (SELECT seq, CASE WHEN c IS NULL OR NOT fine THEN 'UNRESOLVED' WHEN held THEN 'MATCHED_EXISTING_LEAD' ELSE 'NEW_LEAD' END AS decision,
              CASE WHEN c IS NULL THEN 'COMPANY_IDENTITY_UNRESOLVED' WHEN NOT fine THEN 'PERSON_NOT_CURRENTLY_ASSOCIATED_WITH_COMPANY' WHEN held AND p IS NULL THEN 'EXACT_COMPANY_ONLY_MATCH' WHEN held THEN 'EXACT_COMPANY_PERSON_MATCH'
                WHEN p IS NULL THEN 'NEW_COMPANY_ONLY' ELSE 'NEW_COMPANY_PERSON_PAIR' END AS reason FROM m)
            SELECT decision, reason, count(*) AS n, sum(seq)::BIGINT AS seqs FROM d GROUP BY 1, 2""",
        "round_cap": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3",
        "stop_at_target": """SELECT o_custkey, o_orderkey, accepted FROM (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS accepted,
            coalesce(sum((o_orderstatus = 'F')::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM orders) WHERE b < 2""",
        "feedback_counts": f"""WITH {FEEDBACK} SELECT lang AS icp_id, grouping(lang)::INT AS is_global, count(*) FILTER (decision = 'GOOD_FIT') AS n_good_fit, count(*) FILTER (decision = 'WEAK_FIT') AS n_weak_fit,
            count(*) FILTER (decision = 'NOT_FIT') AS n_not_fit, count(*) FILTER (decision = 'HOLD') AS n_hold FROM f GROUP BY ROLLUP (lang)""",
        "feedback_signals": f"WITH {FEEDBACK} SELECT signal, positive, negative, total, round(rate, 6) AS rate, sample FROM k",
        "feedback_recommendations": f"""WITH {FEEDBACK}, t AS (SELECT *, CASE WHEN signal LIKE 'qualification_decision:%' THEN 'RANKING_TIE_BREAK_NUDGE' ELSE 'SOFT_PREFERENCE_WEIGHT_HINT' END AS recommendation_type FROM n WHERE signal NOT LIKE 'hard_rule_result:%')
            SELECT recommendation_type, signal, total, sample, CASE WHEN up THEN 'INCREASE_PRIORITY' ELSE 'DECREASE_PRIORITY' END AS effect, magnitude, substr(sha256('GLOBAL|' || recommendation_type || '|' || signal || '|'), 1, 32) AS fingerprint FROM t""",
        "provider_hints": f"""WITH {FEEDBACK} SELECT 'PROVIDER_PRIORITY_HINT' AS recommendation_type, signal, total, sample, CASE WHEN up THEN 'INCREASE_PROVIDER_USAGE' ELSE 'DECREASE_PROVIDER_USAGE' END AS effect, magnitude,
            substr(sha256('GLOBAL|PROVIDER_PRIORITY_HINT|' || signal || '|'), 1, 32) AS fingerprint FROM n WHERE signal LIKE 'commercial_signal:%'""",
        "reason_frequency": f"""WITH {FEEDBACK}, r AS (SELECT decision, unnest([upper(source), 'SEEN']) AS reason_code FROM f), c AS (SELECT reason_code, count(*) FILTER (decision = 'GOOD_FIT') AS n_good_fit, count(*) FILTER (decision = 'WEAK_FIT') AS n_weak_fit,
            count(*) FILTER (decision = 'NOT_FIT') AS n_not_fit, count(*) FILTER (decision = 'HOLD') AS n_hold, count(*) AS total FROM r GROUP BY 1)
            SELECT *, CASE WHEN total < 5 THEN 'INSUFFICIENT_DATA' WHEN total < 10 THEN 'LOW' WHEN total < 20 THEN 'MODERATE' ELSE 'HIGH' END AS sample FROM c""",
        "feedback_analysis": f"""WITH {FEEDBACK}, c AS (SELECT lang AS icp_id, grouping(lang)::INT AS is_global, count(*) FILTER (decision = 'GOOD_FIT') AS n_good_fit, 0::BIGINT AS n_weak_fit,
            count(*) FILTER (decision = 'NOT_FIT') AS n_not_fit, count(*) FILTER (decision = 'HOLD') AS n_hold, count(*) AS total FROM f GROUP BY ROLLUP (lang))
            SELECT *, total < 50 AS is_cold_start, CASE WHEN total < 50 THEN 'INSUFFICIENT_DATA' WHEN total < 100 THEN 'LOW' WHEN total < 200 THEN 'MODERATE' ELSE 'HIGH' END AS sample FROM c""",
        "export_rows": f"""WITH {SIGNALS} SELECT k::VARCHAR AS lead_id, hard AS hard_rule_result, coalesce(outcome, 'UNKNOWN') AS batch_outcome, CASE WHEN score > 100 THEN 'TRUE' WHEN score IS NULL THEN 'UNKNOWN' ELSE 'FALSE' END AS high FROM t""",
    } | M.oracle_sql(SIGNALS, RULES, STATUS, TIERS) | lead_sql.oracle_sql(SIGNALS)
