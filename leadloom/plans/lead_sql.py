"""What the queries of :mod:`lead_queries` mean, as SQL over the given tables; all fixed values stand here as literals."""

from __future__ import annotations

from .more_queries import FACTS, PEOPLE

COMPANY = "['company_identity', 'domain', 'industry', 'employee_range', 'country', 'company_type', 'business_model', 'linkedin_id', 'revenue_range']"
PERSON = "['person_identity', 'current_title', 'company_association', 'linkedin_id']"


def lines(order: str) -> str:
    return f"ln AS (SELECT * FROM (SELECT *, l_orderkey * 10 + l_linenumber AS cid FROM lineitem) QUALIFY row_number() OVER (PARTITION BY cid ORDER BY {order}) = 1)"


# Customers against profiles; what their industry rows and descriptions cover.
ASKED = """l AS (SELECT c_custkey AS n, c_custkey::VARCHAR AS company_id, 'icp' || (c_custkey % 3) AS icp_id, CASE WHEN c_custkey % 4 = 0 THEN 'q' || c_custkey END AS person_id FROM customer)"""
COVERED = """cv AS (SELECT icp_id, company_id, array_to_string(list_sort(list(DISTINCT value)), '|') AS corroborated, list_sort(list(DISTINCT value)) AS vals FROM l JOIN w ON id = company_id WHERE field = 'industry' AND told IN (0, 1) AND icp_id IN ('icp0', 'icp1')
  GROUP BY 1, 2 HAVING count(DISTINCT told) = 2),
un AS (SELECT DISTINCT icp_id, company_id FROM l JOIN w ON id = company_id WHERE field = 'industry' AND told = 2 AND ((icp_id = 'icp0' AND key IN ('building', 'gift sets')) OR (icp_id = 'icp1' AND key = 'building'))),
ds AS (SELECT icp_id, company_id, 'Skincare' AS stated, 'industries' AS list FROM l JOIN w ON id = company_id WHERE field = 'description' AND icp_id = 'icp0' GROUP BY 1, 2 HAVING bool_or(i3 IN (0, 2)) AND bool_or(i3 IN (0, 1))
  UNION ALL SELECT DISTINCT icp_id, company_id, 'DTC Brand', 'company_types' FROM l JOIN w ON id = company_id WHERE field = 'description' AND icp_id = 'icp1' AND i3 = 2)"""

# Histories of leads.
HISTORY = lines("l_orderkey, l_partkey, l_suppkey, l_quantity, l_shipdate, l_tax") + """,
mb AS (SELECT DISTINCT o_orderstatus AS icp, o_orderkey AS lead, o_custkey AS co, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 END AS pe FROM orders),
r AS (SELECT mb.*, cid, l_partkey AS q, l_suppkey % 7 AS m, l_quantity AS qty, l_shipdate AS tm, l_tax FROM ln JOIN mb ON l_orderkey = lead),
va AS (SELECT icp, co, pe, arg_max(CASE WHEN m = 0 THEN (['PASS', 'PASS', 'HOLD', 'FAIL'])[q % 4 + 1] ELSE 'PASS' END, (tm, cid)) AS hard, arg_max(CASE WHEN m = 0 THEN 'X' ELSE 'Y' END, (tm, cid)) AS codes, arg_max(cid, (tm, cid)) AS vid FROM r WHERE m IN (0, 1) GROUP BY 1, 2, 3),
sc AS (SELECT icp, co, pe, arg_max(qty, (tm, cid)) AS score, arg_max(cid, (tm, cid)) AS sid FROM r WHERE m = 2 GROUP BY 1, 2, 3), qu AS (SELECT icp, co, arg_max(qty, (tm, cid)) AS quality FROM r WHERE m = 4 GROUP BY 1, 2),
ve AS (SELECT icp, co, pe, arg_max((['GOOD_FIT', 'WEAK_FIT', 'NOT_FIT'])[q % 3 + 1], (tm, cid)) AS fit, arg_max((q % 100)::DOUBLE, (tm, cid)) AS sure, arg_max(cid, (tm, cid)) AS qid FROM r WHERE m = 3 GROUP BY 1, 2, 3),
rv AS (SELECT icp, lead, arg_max((['ACCEPT', 'HOLD', 'REJECT'])[q % 3 + 1], (tm, cid)) AS human, arg_max(cid, (tm, cid)) AS rid FROM r WHERE m = 5 GROUP BY 1, 2), it AS (SELECT lead, arg_max((['ACCEPTED', 'DUPLICATE'])[q % 2 + 1], (tm, cid)) AS outcome FROM r WHERE m = 6 GROUP BY 1),
op AS (SELECT DISTINCT co AS e FROM r WHERE l_tax > 0.07 AND q % 3 <> 1),
sg AS (SELECT mb.icp, mb.lead, mb.co, mb.pe, hard, codes, vid, score, sid, quality, fit, sure, qid, CASE WHEN qid % 2 = 0 THEN (['SURVIVES', 'WEAKENED', 'DISPROVED'])[(qid + 5) % 3 + 1] END AS adv_raw, human, rid, outcome, mb.co % 11 = 0 OR (mb.pe % 11 = 0 AND mb.pe IN (SELECT o_custkey FROM orders)) AS clash,
  mb.co IN (SELECT e FROM op) OR coalesce(mb.pe IN (SELECT e FROM op), false) AS open_
  FROM mb LEFT JOIN va ON va.icp = mb.icp AND va.co = mb.co AND va.pe IS NOT DISTINCT FROM mb.pe LEFT JOIN sc ON sc.icp = mb.icp AND sc.co = mb.co AND sc.pe IS NOT DISTINCT FROM mb.pe LEFT JOIN qu ON qu.icp = mb.icp AND qu.co = mb.co
  LEFT JOIN ve ON ve.icp = mb.icp AND ve.co = mb.co AND ve.pe IS NOT DISTINCT FROM mb.pe LEFT JOIN rv ON rv.icp = mb.icp AND rv.lead = mb.lead LEFT JOIN it ON it.lead = mb.lead),
sa AS (SELECT *, CASE WHEN qid % 2 = 0 THEN (['SURVIVES', 'WEAKENED', 'DISPROVED'])[qid % 3 + 1] END AS adv FROM sg)"""
TIERED = HISTORY + """,
tr AS (SELECT *, CASE WHEN hard = 'FAIL' THEN 'HARD_FAILED' WHEN outcome = 'DUPLICATE' THEN 'DUPLICATE' WHEN human = 'REJECT' THEN 'REJECTED' WHEN human = 'ACCEPT' THEN 'ACCEPTED' WHEN human = 'HOLD' THEN 'HOLD' WHEN hard IS NULL OR hard = 'HOLD' THEN 'HOLD'
  WHEN adv = 'DISPROVED' OR fit = 'NOT_FIT' THEN 'REJECTED' WHEN fit IS NULL THEN 'HOLD' WHEN fit = 'GOOD_FIT' AND coalesce(adv, '') <> 'WEAKENED' THEN 'QUALIFIED_STRONG' ELSE 'QUALIFIED_WEAK' END AS tier FROM sa),
rk AS (SELECT *, row_number() OVER (PARTITION BY icp ORDER BY list_position(['ACCEPTED', 'QUALIFIED_STRONG', 'QUALIFIED_WEAK', 'HOLD', 'REJECTED', 'DUPLICATE', 'HARD_FAILED'], tier), coalesce(score, -1) DESC, coalesce(quality, -1) DESC, coalesce(score, -1) DESC, coalesce(sure, -1) DESC, lead) AS rank FROM tr)"""
REVIEWED = TIERED + """,
pv AS (SELECT l_orderkey + 1 AS pe, arg_max(l_partkey, (l_shipdate, l_partkey * 10 + l_linenumber)) FILTER (l_linenumber % 4 = 0) AS title, arg_max(l_partkey, (l_shipdate, l_partkey * 10 + l_linenumber)) FILTER (l_linenumber % 4 = 1) AS email,
  arg_max(l_partkey, (l_shipdate, l_partkey * 10 + l_linenumber)) FILTER (l_linenumber % 4 = 2) AS phone, arg_max(l_partkey, (l_shipdate, l_partkey * 10 + l_linenumber)) FILTER (l_linenumber % 4 = 3) AS lid FROM lineitem GROUP BY 1),
rl AS (SELECT lead, tier, score, fit, c_name AS name, 'c' || co || '.com' AS domain, CASE WHEN co % 3 = 0 THEN 'https://linkedin.com/company/' || co END AS clink, CASE WHEN pe IS NOT NULL THEN 'Ann Lee Roe' END AS person, title, email, phone,
  'https://linkedin.com/in/' || coalesce(CASE WHEN lead % 2 = 0 AND pe IS NOT NULL THEN 'p' || lead END, lid::VARCHAR) AS plink FROM rk LEFT JOIN pv USING (pe) JOIN customer ON co = c_custkey)"""


def oracle_sql(signals: str) -> dict[str, str]:
    full = f"a AS (SELECT c_custkey::VARCHAR AS id, unnest({COMPANY}) AS field FROM customer), al AS (SELECT id, field, status, list_contains({COMPANY}, field) AS critical FROM st UNION ALL SELECT id, field, 'UNKNOWN', true FROM a ANTI JOIN st USING (id, field))"
    status = lambda src: f"SELECT id, field, CASE WHEN count(DISTINCT key) > 1 THEN 'CONFLICT' WHEN count(*) >= 2 OR max(confidence) IN ('MEDIUM', 'HIGH') THEN 'SUPPORTED' ELSE 'INSUFFICIENT' END AS status FROM {src} GROUP BY 1, 2"
    validated = f"""WITH {FACTS}, {PEOPLE}, {ASKED}, {COVERED}, g AS (SELECT id, {', '.join(f"max(CASE WHEN field = '{f}' AND status = 'SUPPORTED' AND NOT (field = 'country' AND key = 'null') THEN {'key' if f in ('industry', 'country', 'company_type') else 'value'} END) AS {f}" for f in ('company_identity', 'domain', 'industry', 'country', 'employee_count', 'employee_range', 'company_type'))} FROM st GROUP BY 1),
            j AS (SELECT l.*, company_identity, domain, country, employee_count::INT AS emp, employee_range AS rng, vals, trim(regexp_replace(lower(vals[1]), '\\s+', ' ', 'g')) AS v1, list_transform(vals, lambda v: trim(regexp_replace(lower(v), '\\s+', ' ', 'g'))) AS vk,
                CASE WHEN un.company_id IS NULL OR cv.vals IS NOT NULL THEN industry END AS proved, d1.stated AS s1, coalesce(company_type, CASE WHEN d2.stated IS NOT NULL THEN 'dtc brand' END) AS kind,
                EXISTS (SELECT 1 FROM ps WHERE ps.id = person_id AND field = 'company_association' AND status = 'SUPPORTED' AND value = l.company_id) AND EXISTS (SELECT 1 FROM ps WHERE ps.id = person_id AND field = 'current_title' AND status = 'SUPPORTED') AS titled
              FROM l LEFT JOIN g ON g.id = l.company_id LEFT JOIN cv USING (icp_id, company_id) LEFT JOIN un USING (icp_id, company_id) LEFT JOIN ds d1 ON d1.company_id = l.company_id AND d1.icp_id = l.icp_id AND d1.list = 'industries'
              LEFT JOIN ds d2 ON d2.company_id = l.company_id AND d2.icp_id = l.icp_id AND d2.list = 'company_types'),
            h AS (SELECT *, coalesce(proved, v1, CASE WHEN s1 IS NOT NULL THEN 'skincare' END) AS ind FROM j),
            z AS (SELECT icp_id, company_id, person_id,
              CASE WHEN icp_id = 'icp2' THEN 'NA' WHEN emp IS NOT NULL THEN CASE WHEN icp_id = 'icp0' AND emp < 10 THEN 'F:EMPLOYEE_TOO_SMALL' WHEN emp > CASE icp_id WHEN 'icp0' THEN 5000 ELSE 3000 END THEN 'F:EMPLOYEE_TOO_LARGE' ELSE 'P' END WHEN rng IS NOT NULL THEN 'P' ELSE 'H:EMPLOYEE_COUNT_UNKNOWN' END AS r1,
              CASE WHEN icp_id = 'icp2' THEN 'NA' WHEN country IS NULL THEN 'H:GEOGRAPHY_UNKNOWN' WHEN (icp_id = 'icp0' AND country = 'US') OR (icp_id = 'icp1' AND country IN ('DE', 'atlantis')) THEN 'P' WHEN icp_id = 'icp0' AND country = 'DE' THEN 'F:WRONG_GEOGRAPHY' ELSE 'H:GEOGRAPHY_UNRESOLVED' END AS r2,
              CASE WHEN ind IS NULL THEN 'H:INDUSTRY_UNKNOWN' WHEN list_contains(coalesce(vk, []), ind) OR (icp_id <> 'icp2' AND ind IN ('skincare', 'beauty')) OR (icp_id = 'icp1' AND ind = 'gift sets') OR (icp_id = 'icp2' AND ind = 'building') THEN 'P' ELSE 'F:INDUSTRY_MISMATCH' END AS r3,
              CASE WHEN icp_id <> 'icp0' OR person_id IS NULL THEN 'NA' WHEN titled THEN 'P' ELSE 'H:TITLE_UNKNOWN' END AS r4, CASE WHEN icp_id <> 'icp1' THEN 'NA' WHEN kind IS NULL THEN 'H:COMPANY_TYPE_UNKNOWN' WHEN kind = 'dtc brand' THEN 'P' ELSE 'F:COMPANY_TYPE_EXCLUDED' END AS r5,
              CASE WHEN icp_id <> 'icp0' THEN 'NA' WHEN kind = 'agency' THEN 'F:EXPLICIT_EXCLUSION' WHEN coalesce(company_identity, domain, ind, country, kind) IS NULL AND NOT titled THEN 'H:INSUFFICIENT_EVIDENCE' ELSE 'P' END AS r6 FROM h),
            y AS (SELECT *, [r1, r2, r3, r4, r5, r6] AS rs FROM z)
            SELECT icp_id, company_id, person_id, CASE WHEN len(list_filter(rs, lambda r: r LIKE 'F:%')) > 0 THEN 'FAIL' WHEN len(list_filter(rs, lambda r: r LIKE 'H:%')) > 0 THEN 'HOLD' ELSE 'PASS' END AS overall,
              array_to_string(list_transform(list_concat(list_filter(rs, lambda r: r LIKE 'F:%'), list_filter(rs, lambda r: r LIKE 'H:%')), lambda r: r[3:]), ',') AS reasons FROM y"""
    return {
        "comparison_keys": """SELECT o_orderkey, CASE WHEN o_orderkey % 9 < 2 THEN CASE WHEN (o_orderkey // 9) % 2 = 0 THEN 'geo:US' ELSE (['u.s.a.', 'united states'])[o_orderkey % 9 + 1] END
            ELSE (['', '', 'emea', '50', '50', '50.0', '{"a": 1, "b": [1, {"c": 1, "d": 2}]}', 'null', 'true'])[o_orderkey % 9 + 1] END AS key FROM orders""",
        "fact_status": f"""WITH {FACTS} SELECT id AS entity_id, field, CASE WHEN count(DISTINCT key) > 1 THEN 'CONFLICT' WHEN count(*) >= 2 OR max(confidence) IN ('MEDIUM', 'HIGH') THEN 'SUPPORTED'
            WHEN max(provider) = 'p1' AND field IN ('industry', 'country', 'employee_range', 'company_type') THEN 'SUPPORTED_STRUCTURED' ELSE 'INSUFFICIENT' END AS status, count(*) AS n_rows, count(DISTINCT provider) > 1 AS corroborated, arg_min(value, (tm, k)) AS value FROM w GROUP BY 1, 2""",
        "all_fields": f"WITH {FACTS}, {full} SELECT id AS entity_id, field, status, critical FROM al",
        "lead_fields": f"""WITH {FACTS}, {PEOPLE}, {ASKED}, cs AS (SELECT id, list(field) AS seen, coalesce(string_agg(field, ',' ORDER BY field) FILTER (status = 'CONFLICT'), '') AS bad FROM st GROUP BY 1), pp AS (SELECT id, list(field) AS seen FROM ps GROUP BY 1),
            m AS (SELECT company_id, coalesce(bad, '') AS bad, list_filter(list_sort({COMPANY}), lambda x: NOT list_contains(coalesce(cs.seen, []), x)) AS cm,
              CASE WHEN person_id IS NULL THEN [] ELSE list_filter(list_sort({PERSON}), lambda x: NOT list_contains(coalesce(pp.seen, []), x)) END AS pm FROM l LEFT JOIN cs ON cs.id = company_id LEFT JOIN pp ON pp.id = person_id)
            SELECT company_id AS lead_id, bad AS conflicting, array_to_string(list_concat(cm, list_filter(pm, lambda x: NOT list_contains(cm, x))), ',') AS missing FROM m""",
        "supported_values": f"""WITH {FACTS}, {PEOPLE}, {ASKED} SELECT id AS lead_id, field, value FROM st WHERE status = 'SUPPORTED' UNION ALL SELECT company_id, 'person.' || field, value FROM l JOIN ps ON ps.id = person_id WHERE status = 'SUPPORTED'""",
        "conflicting_facts": f"WITH {FACTS} SELECT id AS company_id, field, count(*) AS n_facts, count(DISTINCT value) > 1 AS conflict FROM w GROUP BY 1, 2",
        "supporting_evidence": f"WITH {FACTS}, {full} SELECT al.id AS entity_id, al.field, al.status, w.k AS evidence_id FROM al LEFT JOIN w USING (id, field) WHERE critical",
        "verified_fields": f"""WITH {FACTS}, kn AS (SELECT * FROM w WHERE k % 5 > 0), s0 AS ({status('kn')}), us AS (SELECT DISTINCT id, field, provider FROM kn),
            fr AS (SELECT w.id, w.field, w.key, w.provider, 'UNKNOWN' AS confidence FROM w JOIN s0 USING (id, field) ANTI JOIN us ON us.id = w.id AND us.field = w.field AND us.provider = w.provider WHERE k % 5 = 0 AND status <> 'SUPPORTED'),
            bo AS (SELECT id, field, key, confidence FROM kn UNION ALL SELECT id, field, key, confidence FROM fr), s1 AS ({status('bo')}),
            n AS (SELECT s0.*, s1.status AS later, (SELECT count(*) FROM fr WHERE fr.id = s0.id AND fr.field = s0.field) AS n_new, (SELECT count(*) FROM us WHERE us.id = s0.id AND us.field = s0.field) AS n_used FROM s0 JOIN s1 USING (id, field))
            SELECT id AS entity_id, field, CASE WHEN status = 'SUPPORTED' THEN 'NOT_TRIGGERED' WHEN n_used = 3 THEN 'NO_INDEPENDENT_PROVIDERS' WHEN n_new = 0 THEN 'ALL_PROVIDERS_FAILED' ELSE 'SUCCESS' END AS execution,
              CASE WHEN status = 'SUPPORTED' THEN NULL WHEN n_new = 0 THEN 'HOLD' WHEN later = 'SUPPORTED' THEN 'RESOLVED' WHEN later = 'CONFLICT' THEN 'HOLD' ELSE 'UNRESOLVED' END AS outcome, status AS original_status,
              CASE WHEN status <> 'SUPPORTED' AND n_new > 0 THEN later ELSE status END AS resulting_status, n_new FROM n""",
        "streamed_status": """WITH d AS (SELECT user_id, event_type, 'p' || (event_id % 3) AS p, ts, min((((json_extract(props, '$.k')::INT % 2)::VARCHAR), event_id, CASE WHEN value >= 30 THEN 'HIGH' WHEN value >= 20 THEN 'MEDIUM' ELSE 'LOW' END)) AS r FROM events GROUP BY 1, 2, 3, 4)
            SELECT user_id AS entity_id, event_type AS field, CASE WHEN count(DISTINCT r[1]) > 1 THEN 'CONFLICT' WHEN count(*) >= 2 OR max(r[3]) IN ('MEDIUM', 'HIGH') THEN 'SUPPORTED' ELSE 'INSUFFICIENT' END AS status, count(*) AS n_rows FROM d GROUP BY 1, 2""",
        "field_freshness": f"""WITH {FACTS}, a AS (SELECT id, field, date_diff('microsecond', newest, TIMESTAMP '2002-01-01') / 86400000000.0 AS age FROM st), s AS (SELECT id, field, CASE WHEN age <= 30 THEN 100.0 WHEN age >= 180 THEN 0.0 ELSE 100.0 * (180 - age) / 150 END AS score FROM a)
            SELECT id AS entity_id, field, round(score::DOUBLE, 6) AS freshness, score <= 0 AS is_stale FROM s""",
        "split_seen": """WITH a AS (SELECT l_suppkey AS s, l_returnflag AS f, l_partkey % 50 AS e, l_linenumber AS n FROM lineitem), b AS (SELECT s, EXISTS (SELECT 1 FROM a x WHERE x.n <= 3 AND x.s = a.s AND x.f = a.f AND x.e = a.e) AS is_repeat FROM a WHERE n > 3)
            SELECT s AS batch_id, is_repeat, count(*) AS n FROM b GROUP BY 1, 2""",
        "company_evidence": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS u FROM orders WHERE o_custkey % 4 > 0), t AS (SELECT *, CASE WHEN k % 4 = 0 THEN '"industry_match":{"taxonomy_field":"naics","icp_terms":["Skincare","Beauty"]' || CASE WHEN k % 8 = 0 THEN ',"match_scope":"multi_category"' ELSE '' END || ',"branch_total_results":12}' END AS b,
              CASE WHEN k % 9 = 0 THEN '"keyword_match":{"terms":["Beauty"]' || CASE WHEN k % 27 = 0 THEN ',"term_sources":["industry"]' ELSE '' END || '}' END AS w FROM o),
            e AS (SELECT u, k, 'company_identity' AS field, '"Company ' || u || '"' AS v, NULL AS x FROM t UNION ALL SELECT u, k, 'domain', '"c' || u || '.com"', NULL FROM t WHERE k % 2 = 0 UNION ALL SELECT u, k, 'employee_count', k::VARCHAR, NULL FROM t WHERE k % 2 = 0
              UNION ALL SELECT u, k, 'industry', (['"Skin \\"care\\""', '', '"Beauty"'])[(k // 3) % 3 + 1], CASE WHEN b IS NOT NULL OR w IS NOT NULL THEN '{' || concat_ws(',', b, w) || '}' END FROM t WHERE k % 3 = 0 AND (k // 3) % 3 <> 1
              UNION ALL SELECT u, k, 'country', '"US"', NULL FROM t WHERE k % 5 = 0 UNION ALL SELECT u, k, 'description', '"a text"', NULL FROM t WHERE k % 7 = 0
              UNION ALL SELECT u, k, 'company_type', '"DTC"', '{"company_type_match":{"taxonomy_field":"types","icp_term":"DTC"}}' FROM t WHERE k % 6 = 0 AND k % 5 = 1)
            SELECT u AS entity_id, k::VARCHAR AS external_id, field, v AS value_json, x AS evidence_text FROM e""",
        "person_evidence": f"""WITH {lines('l_partkey, l_suppkey, l_returnflag, l_shipdate')}, p AS (SELECT l_partkey AS q, l_suppkey AS s FROM ln WHERE l_partkey > 10),
            e AS (SELECT 'person_identity' AS field, '"Ann ' || q || '"' AS v FROM p UNION ALL SELECT 'current_title', '"CEO"' FROM p WHERE q % 2 = 0 UNION ALL SELECT 'company_association', '"' || s || '"' FROM p WHERE q % 3 > 0 UNION ALL SELECT 'linkedin_id', '"in/p' || q || '"' FROM p WHERE q % 4 < 2)
            SELECT field, v AS value_json, count(*) AS n FROM e GROUP BY 1, 2""",
        "fact_evidence": "SELECT l_partkey AS entity_id, CASE WHEN l_quantity <= 5 THEN 'UNKNOWN' WHEN l_quantity >= 40 THEN 'HIGH' WHEN l_quantity >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, count(*) AS n FROM lineitem GROUP BY 1, 2",
        "discovery_matches": f"""WITH {FACTS}, g AS (SELECT id, bool_or(field = 'industry') AS any_, coalesce(bool_or(field = 'industry' AND told = 2), false) AS branch, arg_min(told, (tm, k)) FILTER (field = 'industry' AND told < 2) AS word FROM w GROUP BY 1)
            SELECT id AS company_id, CASE WHEN branch THEN 'structured' WHEN any_ THEN 'keyword_fallback' ELSE 'unknown' END AS match_type, coalesce((['Skincare', 'x,beauty'])[word + 1], '') AS keyword_terms, coalesce((['industry', 'website,industry'])[word + 1], '') AS keyword_sources,
              CASE WHEN branch THEN 'single_category' ELSE 'unknown' END AS scope, CASE WHEN branch THEN 12 END AS total_results FROM g""",
        "corroborated_terms": f"WITH {FACTS}, {ASKED}, {COVERED} SELECT icp_id, company_id, corroborated FROM cv",
        "unprovable_industries": f"WITH {FACTS}, {ASKED}, {COVERED} SELECT * FROM un",
        "described_terms": f"WITH {FACTS}, {ASKED}, {COVERED} SELECT * FROM ds",
        "validated_leads": validated,
        "cited_rows": f"""WITH {FACTS}, {PEOPLE}, {ASKED}, {COVERED}, ok AS (SELECT id, field FROM st WHERE status = 'SUPPORTED'), hit AS (SELECT id, list(field) AS fs FROM ok GROUP BY 1),
            x AS (SELECT l.icp_id, l.company_id, person_id, CASE WHEN list_contains(fs, 'industry') AND NOT (un.company_id IS NOT NULL AND cv.vals IS NULL) THEN 'industry' WHEN cv.vals IS NOT NULL THEN 'COVERED' WHEN d1.stated IS NOT NULL THEN 'DESCRIBED' END AS ind,
                CASE WHEN d2.stated IS NOT NULL AND NOT coalesce(list_contains(fs, 'company_type'), false) THEN 'DESCRIBED' ELSE 'company_type' END AS kind, CASE WHEN list_contains(fs, 'employee_count') THEN 'employee_count' ELSE 'employee_range' END AS emp,
                CASE WHEN EXISTS (SELECT 1 FROM ps WHERE ps.id = person_id AND field = 'company_association' AND status = 'SUPPORTED' AND value = l.company_id) THEN 'current_title' END AS ttl
              FROM l LEFT JOIN hit ON hit.id = l.company_id LEFT JOIN cv USING (icp_id, company_id) LEFT JOIN un USING (icp_id, company_id) LEFT JOIN ds d1 ON d1.company_id = l.company_id AND d1.icp_id = l.icp_id AND d1.list = 'industries'
              LEFT JOIN ds d2 ON d2.company_id = l.company_id AND d2.icp_id = l.icp_id AND d2.list = 'company_types'),
            y AS (SELECT icp_id, company_id, person_id, 'industry' AS rule, ind AS src FROM x UNION ALL SELECT icp_id, company_id, person_id, 'geography', 'country' FROM x UNION ALL SELECT icp_id, company_id, person_id, 'company_type', kind FROM x
              UNION ALL SELECT icp_id, company_id, person_id, 'allowed_titles', ttl FROM x UNION ALL SELECT icp_id, company_id, person_id, 'employee_range', emp FROM x
              UNION ALL SELECT DISTINCT icp_id, company_id, person_id, 'exclusions', unnest(['company_identity', 'domain', ind, 'country', kind, ttl]) FROM x),
            po AS (SELECT id, field AS src, k AS evidence_id FROM w JOIN ok USING (id, field) UNION ALL SELECT id, 'DESCRIBED', k FROM w WHERE field = 'description'
              UNION ALL SELECT id, 'current_title', l_orderkey * 10 + l_linenumber FROM (SELECT *, 'q' || l_partkey AS id FROM lineitem WHERE l_linenumber % 2 = 1) JOIN ps USING (id) WHERE field = 'current_title' AND status = 'SUPPORTED')
            SELECT icp_id, company_id, person_id, rule, evidence_id FROM y JOIN po ON po.src = y.src AND po.id = CASE WHEN y.src = 'current_title' THEN person_id ELSE company_id END
            UNION ALL SELECT icp_id, company_id, person_id, rule, k FROM y JOIN w ON id = company_id WHERE src = 'COVERED' AND field = 'industry' AND told IN (0, 1)""",
        "json_export": f"WITH {TIERED} SELECT icp AS icp_id, tier, count(*) AS n, min(rank) AS best, count(pe) AS n_people, (sum(count(*)) OVER (PARTITION BY icp))::BIGINT AS lead_count FROM rk GROUP BY icp, tier",
        "stored_tables": """SELECT o_custkey::VARCHAR AS company_id, o_orderstatus AS icp_id, count(*) AS n_leads, 0::BIGINT AS n_people, 0::BIGINT AS n_versions, any_value(n) AS n_rows, 0::BIGINT AS n_urls
            FROM orders JOIN (SELECT o_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) USING (o_custkey) GROUP BY o_custkey, o_orderstatus""",
        "value_texts": "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN c_name || ' ' || c_mktsegment WHEN 1 THEN c_mktsegment || ' ' || c_custkey WHEN 2 THEN c_name WHEN 3 THEN c_custkey::VARCHAR END AS text FROM customer",
        "snapshot_as_of": """WITH s AS (SELECT o_orderpriority[1] AS icp_id, o_orderkey AS k, o_orderdate AS d, CASE WHEN o_orderpriority[1] = '3' THEN '1996-01-01' ELSE '1998-01-01' END AS snapshot_date FROM orders)
            SELECT icp_id, snapshot_date, count(*) AS n, sum(k)::BIGINT AS leads FROM s WHERE d < snapshot_date::DATE GROUP BY 1, 2""",
        "profile_errors": """SELECT c_custkey AS icp_id, concat_ws(',', CASE WHEN c_custkey % 14 = 0 THEN 'EMPLOYEE_RANGE_REVERSED' END,
            CASE WHEN c_custkey % 3 > 0 AND c_custkey % 4 > 0 AND c_custkey % 5 > 0 AND c_custkey % 7 > 0 AND c_custkey % 2 > 0 THEN 'PROFILE_EMPTY' END, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 5 = 0 THEN 'GEOGRAPHY_REPEATED' END,
            CASE WHEN c_custkey % 9 = 0 THEN 'EXCLUSION_IS_ALLOWED' END) AS errors FROM customer""",
        "canonical_profiles": """WITH k AS (SELECT c_custkey AS k, c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN 0 WHEN c_custkey % 5 = 0 THEN 1 ELSE 2 END AS g FROM customer)
            SELECT k AS icp_id, CASE WHEN k % 3 = 0 THEN 'Skin care,Beauty' ELSE '' END AS industries, (['US', 'FR', ''])[g + 1] AS country_codes, (['usa', 'France', ''])[g + 1] AS country_texts, (['EMEA', 'Narnia', ''])[g + 1] AS other_places, CASE WHEN k % 9 = 0 THEN 'beauty' ELSE '' END AS excluded, 'sells to ' || c_mktsegment || ',Ships abroad' AS custom_rules,
              CASE WHEN k % 7 = 0 THEN 50 END AS min_employees FROM k""",
        "projected_filters": """WITH e AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS p, (l_linenumber + (l_orderkey % 10 = 0)::INT - 1) % 8 AS i FROM lineitem), b AS (SELECT *, CASE WHEN i = 7 THEN 'UNKNOWN_KEY:colour' WHEN i = 4 AND o % 17 = 0 THEN 'INVALID_OPERATOR:custom' END AS bad FROM e),
            g AS (SELECT o, coalesce(string_agg(bad, ',' ORDER BY bad), '') AS errors, coalesce(string_agg('t' || p, ',' ORDER BY p) FILTER (i IN (0, 6)), '') AS industry, coalesce(string_agg('t' || p, ',' ORDER BY p) FILTER (i = 1), '') AS geography, coalesce(max('t' || p) FILTER (i = 3), '') AS exclusions,
              max(10) FILTER (i = 2) AS lo, max(p) FILTER (i = 2) AS hi, coalesce(max('Custom requirement=sells online') FILTER (i = 4), '') AS custom, coalesce(max('Funding=in: t' || p) FILTER (i = 5), '') AS other FROM b GROUP BY 1)
            SELECT o AS icp_id, errors, CASE WHEN errors = '' THEN industry END AS industry, CASE WHEN errors = '' THEN geography END AS geography, CASE WHEN errors = '' THEN exclusions END AS exclusions, CASE WHEN errors = '' THEN lo END AS min_employees, CASE WHEN errors = '' THEN hi END AS max_employees,
              CASE WHEN errors = '' THEN custom END AS custom_rules, CASE WHEN errors = '' THEN other END AS other_preferences FROM g""",
        "extracted_filters": """WITH t AS (SELECT c_custkey AS k, lower(c_mktsegment) AS seg, c_name, (['canada', 'uae', 'france', 'the us'])[c_nationkey % 4 + 1] AS place, c_custkey % 5 = 0 AS both_ FROM customer),
            m AS (SELECT *, CASE WHEN place = 'the us' AND seg = 'household' THEN 'ho ehold' ELSE seg END AS seg_left, CASE WHEN place IN ('canada', 'uae') THEN ' ' WHEN place = 'the us' AND seg <> 'household' THEN 'the  ' ELSE place END AS place_left FROM t)
            SELECT k AS icp_id, CASE WHEN both_ THEN 'D2C|SaaS' ELSE '' END AS industry, CASE place WHEN 'canada' THEN 'Canada' WHEN 'uae' THEN 'UAE' WHEN 'the us' THEN 'United States' ELSE '' END AS geography, '' AS allowed_titles, '' AS funding, '' AS hiring,
              CASE WHEN k % 3 = 0 THEN upper(seg[1]) || seg[2:] || ' Vendors|SaaS Except For E-Commerce Shops|E-Commerce Shops' ELSE '' END AS exclusions, CASE WHEN k % 2 = 0 THEN 'They sell to every ' || seg || ' buyer as ' || c_name || '.' ELSE '' END AS requirements,
              CASE WHEN both_ THEN 'Find saas|d2c ' ELSE 'Find ' END || seg_left || ' companies in ' || place_left || ' with' AS unmatched, k AS min_employees, k + 500 AS max_employees,
              CASE WHEN k % 4 = 1 THEN k * 1000000 END AS min_revenue, CASE WHEN k % 4 = 1 THEN 2000000000 END::BIGINT AS max_revenue FROM m""",
        "merged_strategies": """WITH p AS (SELECT p_partkey, p_type AS t, string_split(p_name, ' ') AS n FROM part)
            SELECT p_partkey, concat_ws(',', t, CASE WHEN lower(n[1]) <> lower(t) THEN lower(n[1]) END, CASE WHEN lower(n[2]) NOT IN (lower(t), lower(n[1])) THEN lower(n[2]) END, 'Gift') AS industries, 'Gift' AS combinations, 'DTC,B2B' AS company_types, '' AS excluded FROM p""",
        "size_buckets": """WITH b(s, lo, hi) AS (VALUES ('1-10', 1, 10), ('11-50', 11, 50), ('51-200', 51, 200), ('201-500', 201, 500), ('501-1000', 501, 1000), ('1001-5000', 1001, 5000), ('5001-10000', 5001, 10000), ('10001+', 10001, 2000000000)),
            k AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 700 * 3 END AS a, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 900 * 7 END AS z FROM customer)
            SELECT c_custkey, CASE WHEN a IS NOT NULL OR z IS NOT NULL THEN (SELECT string_agg(s, ',' ORDER BY lo) FROM b WHERE hi >= coalesce(a, 0) AND lo <= coalesce(z, 2000000000) AND coalesce(a, 0) <= coalesce(z, 2000000000)) END AS sizes FROM k""",
        "directory_results": """WITH k AS (SELECT o_orderkey, o_orderkey % 9 AS u, (o_orderkey // 9) % 4 AS t, o_orderkey % 3 AS b FROM orders)
            SELECT o_orderkey, (['yc:acme-co', NULL, 'crunchbase:acme', 'lever:acme-co', 'greenhouse:acme_labs', NULL, NULL, NULL, NULL])[u + 1] AS external_id,
              CASE u WHEN 0 THEN (['Acme', 'Acme - Crunchbase Company Profile & Funding', 'Acme Ltd - Engineer', 'acme-co'])[t + 1] WHEN 2 THEN (['Acme: the shop | Y Combinator', 'Acme', 'Acme Ltd - Engineer', 'acme'])[t + 1]
                WHEN 3 THEN (['Acme: the shop', 'Acme', 'Acme Ltd', 'acme-co'])[t + 1] WHEN 4 THEN 'Acme Labs' END AS name, u = 5 AS homepage, b > 0 AS blocked FROM k""",
        "resolved_homepages": """SELECT o_custkey AS candidate_id, 'shop' || min(o_orderkey) || '.com' AS domain FROM orders WHERE o_orderkey % 8 IN (0, 2) AND ((o_custkey % 3 = 0 AND (o_orderkey // 8) % 3 = 0) OR (o_custkey % 3 = 2 AND (o_orderkey // 8) % 3 <> 1)) GROUP BY 1""",
        "vendor_facts": """WITH a AS (SELECT o_orderkey AS k, c_name, c_mktsegment AS seg, o_orderpriority AS pri, o_orderdate, c_nationkey, (['verified', 'guessed', NULL, NULL])[(o_orderkey // 6) % 4 + 1] AS st FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 11 <> 0),
            f AS (SELECT k, k::VARCHAR AS external_id, c_name AS name, unnest(['current_title', 'company_association', 'linkedin_id', 'linkedin_url']) AS field, unnest(['Head of ' || pri, seg, 'in/p' || k, 'https://www.linkedin.com/in/p' || k]) AS value FROM a WHERE k % 6 = 0
              UNION ALL SELECT k, k || 'b', 'Bo', unnest(['linkedin_id', 'linkedin_url']), unnest(['in/bo', 'https://www.linkedin.com/in/bo']) FROM a WHERE k % 6 = 0
              UNION ALL SELECT k, k::VARCHAR, c_name, unnest(['current_title', 'email', 'email_status']), unnest([seg, k || '@x.com', st]) FROM a WHERE k % 6 = 1
              UNION ALL SELECT k, k::VARCHAR, 'first', unnest(['industry', 'founded_year']), unnest([seg, year(o_orderdate)::VARCHAR]) FROM a WHERE k % 6 = 2
              UNION ALL SELECT k, k::VARCHAR, NULL, unnest(['industry', 'country']), unnest([seg, 'N' || c_nationkey]) FROM a WHERE k % 6 = 3
              UNION ALL SELECT k, k::VARCHAR, NULL, 'email_is_disposable', (k % 4 = 0)::VARCHAR FROM a WHERE k % 6 = 4
              UNION ALL SELECT k, k::VARCHAR, NULL, unnest(['phone_is_valid', 'phone_line_type']), unnest([(k % 4 = 1)::VARCHAR, (['mobile', 'fixed'])[(k // 6) % 2 + 1]]) FROM a WHERE k % 6 = 5)
            SELECT f.k AS entity_id, 'v' || (f.k % 6) AS provider, external_id, name, field, value, CASE WHEN field = 'email' AND st = 'verified' THEN 'HIGH' WHEN field = 'email' AND st = 'guessed' THEN 'LOW' ELSE 'UNKNOWN' END AS confidence FROM f JOIN a USING (k) WHERE value IS NOT NULL""",
        "vendor_records": """SELECT o_custkey AS run_id, o_orderkey::VARCHAR AS external_id, CASE o_orderkey % 3 WHEN 0 THEN 'Acme' ELSE 'B "x"' END AS name, 'employee_count' AS only, (o_orderkey % 5)::VARCHAR AS employee_count FROM orders WHERE o_orderkey % 7 > 0 AND o_orderkey % 3 <> 1""",
        "profile_ids": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN 'in/ann' ELSE (['in/bob', 'in/x', ' company/y', NULL])[(o_orderkey // 3) % 4 + 1] END AS profile_id FROM orders",
        "branch_sightings": """WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS seq, min(l_partkey) AS p, min(l_returnflag) AS f, min(l_linestatus) AS st, min(l_quantity) AS q FROM lineitem GROUP BY 1),
            t AS (SELECT p, seq, 1 AS pos, 'a' AS kind, f AS term FROM s WHERE st = 'F' UNION ALL SELECT p, seq, 1, 'b', st FROM s WHERE st = 'F' UNION ALL SELECT p, seq, 2, 'b', f FROM s WHERE st = 'F' AND q <= 25 UNION ALL SELECT p, seq, 1, 'c', f || st FROM s WHERE st <> 'F' UNION ALL SELECT p, seq, 2, 'c', f FROM s WHERE st <> 'F'),
            u AS (SELECT p, kind, term, min((seq, pos)) AS at_ FROM t GROUP BY 1, 2, 3), g AS (SELECT p, string_agg(term, ',' ORDER BY at_) FILTER (kind = 'a') AS a, string_agg(term, ',' ORDER BY at_) FILTER (kind = 'b') AS b, string_agg(term, ',' ORDER BY at_) FILTER (kind = 'c') AS c FROM u GROUP BY 1)
            SELECT s.p AS l_partkey, min(seq) AS seq, arg_min(CASE WHEN q > 25 THEN 'single_category' ELSE 'multi_category' END, seq) FILTER (st = 'F') AS industry_match_scope, arg_min(CASE WHEN q > 25 THEN 1 ELSE 2 END, seq) FILTER (st = 'F') AS industry_match_resolved_category_count,
              any_value(a) AS industry_match_terms, any_value(b) AS industry_match_resolved_values, any_value(c) AS keyword_match_terms FROM s JOIN g USING (p) GROUP BY 1""",
        "allowed_sources": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey // 4) % 3 <> 0 WHEN 1 THEN (o_orderkey // 4) % 3 = 0 ELSE true END AS allowed FROM orders",
        "mock_entities": "SELECT o_orderkey AS entity_id, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey % 4 = 2) AS is_mock FROM orders",
        "reopened_items": "SELECT o_orderkey, NULL::VARCHAR AS outcome, NULL::VARCHAR AS hard_rule_result, 'COMPANY_RESOLVED' AS stage FROM orders o WHERE o_orderkey % 3 = 0 AND EXISTS (SELECT 1 FROM orders x WHERE x.o_orderstatus = 'P' AND x.o_custkey = o.o_custkey AND x.o_orderpriority = o.o_orderpriority)",
        "new_memberships": "SELECT DISTINCT l_partkey AS lead_id, l_returnflag AS icp_id, l_linenumber AS icp_version FROM lineitem WHERE l_linenumber >= 3 AND l_partkey % 5 > 0",
        "linked_repeats": f"""WITH {lines('l_partkey, l_suppkey, l_returnflag, l_linenumber')}, k AS (SELECT l_returnflag AS f, l_partkey AS e, arg_min(l_suppkey, cid) AS company_id FROM ln WHERE l_linenumber <= 3 AND l_suppkey % 3 > 0 GROUP BY 1, 2)
            SELECT company_id, count(*) AS n FROM ln JOIN k ON f = l_returnflag AND e = l_partkey WHERE l_linenumber > 3 GROUP BY 1""",
        "run_summary": f"""WITH {signals}, g AS (SELECT icp_id, count(*) AS lead_count, count(*) FILTER (k % 5 = 0) AS accepted_count, count(*) FILTER (k % 5 = 1) AS held_count, count(*) FILTER (k % 5 = 2) AS rejected_count, count(*) FILTER (k % 5 = 3) AS duplicate_count,
              count(*) FILTER (hard = 'PASS' AND human IS NULL) AS review_pending_count, count(human) AS reviewed_count, count(tier) AS ranked_count FROM t GROUP BY 1)
            SELECT *, CASE icp_id WHEN 'BUILDING' THEN 2 ELSE 0 END::BIGINT AS failed_count, CASE icp_id WHEN 'BUILDING' THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END AS status FROM g
            UNION ALL SELECT 'OTHER', 0, 0, 0, 0, 0, 0, 0, 0, 0, 'COMPLETED'""",
        "lead_statuses": f"""WITH {signals} SELECT icp_id, k AS lead_id, k % 97 AS company_id, CASE WHEN k % 3 = 0 THEN k + 1 END AS person_id, outcome AS batch_outcome, hard AS hard_rule_result,
            CASE WHEN k % 9 = 0 THEN 'CONFLICTED' WHEN hard <> 'PASS' THEN 'INSUFFICIENT_EVIDENCE' WHEN k % 4 = 0 THEN 'PARTIALLY_VERIFIED' ELSE 'VERIFIED' END AS readiness, tier AS ranking_tier, human AS human_review_decision, hard = 'PASS' AND human IS NULL AS human_review_pending FROM t""",
        "stage_tallies": f"""WITH {signals}, i AS (SELECT c_mktsegment AS icp_id, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS bad FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1),
            g AS (SELECT icp_id, count(*) AS leads, count(human) AS done, count(*) FILTER (hard = 'PASS' AND human IS NULL) AS waiting, count(tier) AS ranked FROM t GROUP BY 1), b AS (SELECT icp_id, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, coalesce(leads, 0) AS leads, coalesce(done, 0) AS done, coalesce(waiting, 0) AS waiting, coalesce(ranked, 0) AS ranked FROM i FULL JOIN g USING (icp_id)),
            s(position, stage) AS (VALUES (0, 'DISCOVERY'), (1, 'COMPANY_RESOLUTION'), (2, 'ENRICHMENT'), (3, 'PEOPLE_DISCOVERY_RESOLUTION'), (4, 'EVIDENCE'), (5, 'HARD_VALIDATION'), (6, 'VERIFICATION'), (7, 'BUSINESS_MODEL_SIGNALS'), (8, 'SCORING'), (9, 'LLM_QUALIFICATION'), (10, 'ADVERSARIAL_REVIEW'), (11, 'DEDUPLICATION'))
            SELECT icp_id, position, stage, n AS attempted, n - bad AS succeeded, bad AS failed, 0::BIGINT AS pending FROM b, s UNION ALL SELECT icp_id, 12, 'HUMAN_REVIEW', leads, done, 0, waiting FROM b UNION ALL SELECT icp_id, 13, 'RANKING', leads, ranked, 0, 0 FROM b
            UNION ALL SELECT icp_id, 14, 'CONFIDENCE', leads, leads, 0, 0 FROM b UNION ALL SELECT icp_id, 15, 'EXPORT', 1, 1, 0, 0 FROM b""",
        "applied_matches": f"WITH {MATCHED} SELECT company_id, domain, 'Old name' || coalesce('|' || alias, '') AS aliases, coalesce(ids, '') AS ids FROM af",
        "match_conflicts": f"""WITH {MATCHED}, x AS (SELECT concat_ws(',', CASE WHEN m.dom IS NOT NULL AND m.dom IS DISTINCT FROM af.domain THEN 'domain_conflict' END, CASE WHEN m.ext <> id.own THEN 'provider_identity_conflict' END) AS conflicts
            FROM m JOIN af ON m.s = company_id JOIN id ON id.s = m.s AND id.prov = m.prov) SELECT conflicts, count(*) AS n FROM x GROUP BY 1""",
        "applied_person_matches": f"""WITH {lines('l_partkey, l_suppkey, l_returnflag, l_shipdate')}, m AS (SELECT l_partkey AS q, l_returnflag AS f, CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey::VARCHAR END AS co, CASE WHEN l_suppkey % 2 = 0 THEN 'in/s' || l_suppkey END AS pr, (l_shipdate, cid) AS o FROM ln),
            fc AS (SELECT q, co, min(o) AS o FROM m WHERE co IS NOT NULL AND co <> '7' GROUP BY 1, 2), cl AS (SELECT q, string_agg(co, ',' ORDER BY o) AS cs FROM fc GROUP BY 1),
            g AS (SELECT q, string_agg(DISTINCT f, ',' ORDER BY f) AS providers, arg_min(pr, o) FILTER (pr IS NOT NULL) AS pr, arg_min(co, o) FILTER (co IS NOT NULL) AS co FROM m GROUP BY 1),
            a AS (SELECT p_partkey AS q, providers, CASE WHEN p_partkey % 3 = 0 THEN 'in/old' ELSE pr END AS profile_id, CASE WHEN p_partkey % 2 = 0 THEN '7' ELSE co END AS company_id, '7' || coalesce(',' || cs, '') AS companies FROM part LEFT JOIN g ON g.q = p_partkey LEFT JOIN cl ON cl.q = p_partkey),
            n AS (SELECT m.q, count(*) AS n_clash FROM m JOIN a USING (q) WHERE m.pr <> a.profile_id GROUP BY 1)
            SELECT a.q AS person_id, 0 AS n_aliases, coalesce(providers, '') AS providers, profile_id, company_id, companies, n_clash FROM a LEFT JOIN n USING (q)""",
        "assembled_signals": f"""WITH {HISTORY} SELECT icp AS icp_id, lead AS lead_id, hard AS hard_rule_result, score AS final_score, quality AS company_quality_score, fit AS qualification_decision, sure AS qualification_confidence, adv AS adversarial_result, human AS human_review_decision, outcome AS batch_outcome,
            coalesce(clash, false) AS evidence_has_conflicts, open_ AS verification_unresolved FROM sa""",
        "crm_leads": f"""WITH {TIERED}, b AS (SELECT CASE WHEN lead % 4 = 0 THEN 'a@b.c' ELSE 'UNKNOWN' END AS email, CASE WHEN pe IS NULL THEN 'UNKNOWN' ELSE 'Ann Lee' END AS first_name, CASE WHEN pe IS NULL THEN 'UNKNOWN' ELSE 'Roe' END AS last_name, c_name AS company FROM rk JOIN customer ON co = c_custkey)
            SELECT *, unnest(['hubspot', 'salesforce']) AS layout FROM b""",
        "exported_leads": f"""WITH {TIERED}, li AS (SELECT l_orderkey AS lead, list_sort(list(DISTINCT (l_orderkey * 10 + l_linenumber)::VARCHAR)) AS ids FROM lineitem GROUP BY 1),
            u AS (SELECT rk.*, c_name, coalesce(ids, []) AS ids, coalesce(hard = 'FAIL', false) AS x FROM rk JOIN customer ON co = c_custkey LEFT JOIN li USING (lead)),
            c AS (SELECT *, CASE WHEN tier = 'HARD_FAILED' THEN ['HARD_RULE_FAIL'] WHEN outcome = 'DUPLICATE' THEN ['HUMAN_DUPLICATE'] WHEN human = 'REJECT' THEN ['HUMAN_REJECTED'] WHEN human = 'ACCEPT' THEN ['HUMAN_ACCEPTED'] WHEN human = 'HOLD' THEN ['HUMAN_HELD'] WHEN hard = 'HOLD' THEN ['HARD_RULE_HOLD']
                WHEN hard IS NULL THEN ['HARD_RULE_UNKNOWN'] WHEN adv = 'DISPROVED' THEN ['HARD_RULE_PASS', 'ADVERSARIAL_DISPROVED'] WHEN fit = 'NOT_FIT' THEN ['HARD_RULE_PASS', 'QUALIFICATION_NOT_FIT'] WHEN fit IS NULL THEN ['HARD_RULE_PASS', 'QUALIFICATION_MISSING']
                ELSE ['HARD_RULE_PASS', 'QUALIFICATION_' || fit, 'ADVERSARIAL_' || coalesce(adv, 'MISSING')] END AS why, list_filter([CASE WHEN score IS NULL AND hard = 'PASS' THEN 'SCORE_MISSING' END, CASE WHEN quality IS NULL AND hard IN ('PASS', 'HOLD') THEN 'COMPANY_QUALITY_MISSING' END,
                CASE WHEN clash THEN 'EVIDENCE_CONFLICTS_PRESENT' END, CASE WHEN open_ THEN 'VERIFICATION_UNRESOLVED' END], lambda v: v IS NOT NULL) AS more FROM u)
            SELECT '1.0.0' AS schema_version, icp AS icp_id, '1' AS icp_version, 'UNKNOWN' AS batch_id, lead::VARCHAR AS lead_id, co::VARCHAR AS company_id, c_name AS company_name, 'c' || co || '.com' AS company_domain, coalesce(pe::VARCHAR, 'UNKNOWN') AS person_id, CASE WHEN pe IS NULL THEN 'UNKNOWN' ELSE 'Ann Lee Roe' END AS person_name,
              'UNKNOWN' AS person_title, CASE WHEN pe IS NULL THEN 'UNKNOWN' ELSE 'in/' || lead END AS person_linkedin_id, coalesce(hard, 'UNKNOWN') AS hard_rule_result, coalesce(codes, '') AS hard_rule_reason_codes, {', '.join(f"coalesce(score::VARCHAR, 'UNKNOWN') AS {n}" for n in ('final_score', 'icp_score', 'commercial_score', 'evidence_score', 'freshness_score', 'identity_confidence'))},
              coalesce(fit, 'UNKNOWN') AS qualification_decision, coalesce(sure::VARCHAR, 'UNKNOWN') AS qualification_confidence, CASE WHEN fit IS NULL THEN 'UNKNOWN' ELSE 'fits' END AS qualification_summary, coalesce(adv, 'UNKNOWN') AS adversarial_result, CASE WHEN adv IS NULL THEN 'UNKNOWN' ELSE '50.0' END AS adversarial_confidence,
              CASE WHEN open_ THEN 'UNRESOLVED' ELSE 'UNKNOWN' END AS verification_status, coalesce(human, 'UNKNOWN') AS human_review_decision, CASE WHEN human IS NULL THEN '' ELSE 'SEEN' END AS human_review_reason_codes, rank::VARCHAR AS rank, tier, array_to_string(list_concat(why, more), ';') AS ranking_reason_codes,
              CASE WHEN tier = 'DUPLICATE' THEN 'TRUE' ELSE 'FALSE' END AS is_duplicate_occurrence, 'industry' AS evidence_conflicting_fields, '' AS evidence_missing_critical_fields, array_to_string(ids, ';') AS evidence_ids, coalesce(vid::VARCHAR, 'UNKNOWN') AS hard_validation_id, coalesce(sid::VARCHAR, 'UNKNOWN') AS score_id,
              coalesce(qid::VARCHAR, 'UNKNOWN') AS qualification_id, CASE WHEN adv IS NULL THEN 'UNKNOWN' ELSE (qid + 5)::VARCHAR END AS adversarial_review_id, array_to_string(list_filter(ids, lambda v: v::BIGINT % 3 = 0), ';') AS verification_ids, coalesce(rid::VARCHAR, 'UNKNOWN') AS human_review_id,
              array_to_string(list_filter(ids, lambda v: v::BIGINT % 10 = 1), ';') AS deduplication_ids, co::VARCHAR AS company_resolution_id, coalesce(pe::VARCHAR, 'UNKNOWN') AS person_resolution_id, CASE WHEN pe IS NULL THEN 'pa' ELSE 'pa;pb' END AS source_provider_ids, '2024-02-01T00:00:00+00:00' AS exported_at FROM c""",
        "review_table": f"""WITH {REVIEWED} SELECT name AS company, domain AS company_domain, coalesce(clink, '') AS company_linkedin, coalesce(person, '') AS person, coalesce(title::VARCHAR, '') AS title, coalesce(email::VARCHAR, '') AS email, '' AS email_status, coalesce(phone::VARCHAR, '') AS phone, coalesce(plink, '') AS person_linkedin, tier,
            coalesce(score::VARCHAR, '') AS final_score, coalesce(fit, '') AS qualification, CASE WHEN email IS NULL THEN 'not enriched' ELSE 'enriched' END AS enrichment_status FROM rl""",
        "filtered_reviews": f"WITH {REVIEWED} SELECT lead AS lead_id, tier, domain AS company_domain FROM rl WHERE domain LIKE 'c1%' AND tier IN ('ACCEPTED', 'QUALIFIED_STRONG') AND email IS NOT NULL",
        "review_queue": f"""WITH {HISTORY}, v AS (SELECT lead, icp, co, unnest(CASE WHEN lead % 2 = 0 THEN [0] ELSE [0, 1] END)::BIGINT AS icp_version FROM mb) SELECT v.lead AS lead_id, v.icp AS icp_id, icp_version, v.co AS company_id, human AS latest_review_decision, human IS NOT NULL AS already_reviewed FROM v LEFT JOIN rv ON rv.icp = v.icp AND rv.lead = v.lead""",
        "newest_values": f"WITH {FACTS} SELECT id AS entity_id, {', '.join(f"arg_max(value, (tm, k)) FILTER (field = '{f}') AS {f}" for f in ('industry', 'country', 'employee_range'))} FROM w WHERE field IN ('industry', 'country', 'employee_range') GROUP BY 1",
        "review_history": f"WITH {HISTORY} SELECT lead AS lead_id, cid AS id, (['ACCEPT', 'HOLD', 'REJECT'])[q % 3 + 1] AS decision FROM r WHERE m = 5 AND icp = 'F'",
        "verdict_contexts": f"""WITH {FACTS}, {ASKED}, pf AS (SELECT 'q' || l_partkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'company_association' ELSE 'current_title' END AS field, CASE WHEN l_linenumber % 2 = 0 THEN (l_partkey % 150)::VARCHAR ELSE (['VP of Sales', 'CEO'])[l_partkey % 2 + 1] END AS value,
              l_shipdate AS tm, (l_orderkey * 10 + l_linenumber)::VARCHAR AS k FROM lineitem), e AS (SELECT id, field, value, min((tm, k::VARCHAR)) AS f FROM w GROUP BY 1, 2, 3 UNION ALL SELECT id, field, value, min((tm, k)) FROM pf GROUP BY 1, 2, 3),
            x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY f, field, left(value, 9)) AS n FROM e), y AS (SELECT company_id, 0 AS side, x.n, field, value FROM l JOIN x ON id = company_id WHERE x.n <= 6 UNION ALL SELECT company_id, 1, x.n, field, value FROM l JOIN x ON id = person_id WHERE x.n <= 6),
            z AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY side, n) AS p FROM y), t AS (SELECT company_id, count(*) AS n, string_agg(field || '=' || left(value, 9), '|' ORDER BY field || '=' || left(value, 9)) AS told FROM z WHERE p <= 6 GROUP BY 1)
            SELECT l.company_id AS lead_id, coalesce(t.n, 0)::INT AS n, 'company_id' AS first, coalesce(told, '') AS told FROM l LEFT JOIN t USING (company_id)""",
        "full_contexts": f"""WITH q AS ({validated}), {FACTS}, {PEOPLE}, {ASKED}, {COVERED}, cf AS (SELECT id, coalesce(string_agg(field, ',' ORDER BY field) FILTER (status = 'CONFLICT'), '') AS bad, list(field) AS seen FROM st GROUP BY 1),
            od AS (SELECT o_custkey::VARCHAR AS id, count(*) AS n, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS s FROM orders GROUP BY 1), ec AS (SELECT id, count(DISTINCT (field, value)) AS n FROM w GROUP BY 1), ep AS (SELECT id, count(DISTINCT (field, value)) AS n FROM pw GROUP BY 1)
            SELECT l.company_id AS lead_id, overall AS hard_rule_result, q.reasons, 6 AS n_rules, array_to_string(vals, ',') AS keyword_terms, bad AS conflicting_fields, array_to_string(list_filter({COMPANY}, lambda x: NOT list_contains(seen, x)), ',') AS missing_fields,
              od.n AS n_orders, od.s AS signals, least(40, coalesce(ec.n, 0) + coalesce(ep.n, 0))::INT AS n_evidence
            FROM l JOIN q USING (company_id) LEFT JOIN cv ON cv.company_id = l.company_id AND cv.icp_id = l.icp_id LEFT JOIN cf ON cf.id = l.company_id LEFT JOIN od ON od.id = l.company_id LEFT JOIN ec ON ec.id = l.company_id LEFT JOIN ep ON ep.id = l.person_id""",
        "feedback_observations": """WITH h AS (SELECT o_orderstatus AS icp, o_custkey AS co, max((['FAIL', 'HOLD', 'PASS'])[o_orderkey % 3 + 1]) AS hard FROM orders GROUP BY 1, 2), g AS (SELECT o_orderkey + 5 AS ref, o_orderstatus AS icp, (['GOOD_FIT', 'WEAK_FIT', 'NOT_FIT', 'HOLD'])[o_orderkey % 4 + 1] AS decision FROM orders),
            s AS (SELECT ref, g.icp, decision, o.o_custkey AS co, unnest(list_filter([CASE WHEN hard IS NOT NULL THEN 'hard_rule_result:' || hard END, CASE WHEN c_custkey % 3 IN (0, 1) THEN 'business_model:DTC' END, CASE WHEN c_custkey % 3 = 1 THEN 'business_model:HYBRID' END, CASE WHEN c_custkey % 3 = 1 THEN 'business_model:B2B' END,
              CASE WHEN c_nationkey % 2 = 0 THEN 'commercial_signal:NATION_' || c_nationkey END, ''], lambda v: v IS NOT NULL)) AS v FROM g LEFT JOIN orders o ON o.o_orderkey = ref LEFT JOIN customer ON c_custkey = o.o_custkey LEFT JOIN h ON h.icp = g.icp AND h.co = o.o_custkey)
            SELECT ref AS lead_ref, icp AS icp_id, decision, coalesce(string_agg(v, ',' ORDER BY v) FILTER (v <> ''), '') AS signals FROM s GROUP BY 1, 2, 3""",
        "provider_signals": """WITH p AS (SELECT unnest(['p' || l_suppkey, 'q' || (l_suppkey % 3)]) AS provider, l_returnflag AS f FROM lineitem) SELECT provider, string_agg(DISTINCT 'commercial_signal:' || f, ',' ORDER BY 'commercial_signal:' || f) AS signals FROM p GROUP BY 1""",
    }


# Matched candidates: the first id of each provider, the first claim of a domain, new names.
MATCHED = lines("l_suppkey, l_returnflag, l_linestatus, l_partkey, l_shipdate") + """,
m AS (SELECT l_suppkey AS s, l_returnflag AS prov, (l_partkey % 4)::VARCHAR AS ext, (['Old NAME', 'New x', 'new x'])[l_partkey % 3 + 1] AS name, CASE WHEN l_linestatus = 'F' THEN 's' || l_suppkey || '.com' WHEN l_partkey % 5 = 0 THEN 's1.com' END AS dom, (l_shipdate, cid) AS o FROM ln),
fi AS (SELECT s, prov, arg_min(ext, o) AS ext FROM m GROUP BY 1, 2),
id AS (SELECT s, prov, CASE WHEN prov = 'A' AND s % 2 = 0 THEN s::VARCHAR ELSE ext END AS own FROM fi UNION ALL SELECT s_suppkey, 'A', s_suppkey::VARCHAR FROM supplier WHERE s_suppkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM fi WHERE fi.s = s_suppkey AND prov = 'A')),
il AS (SELECT s, string_agg(prov || ':' || own, ',' ORDER BY prov) AS ids FROM id GROUP BY 1), na AS (SELECT s, arg_min(name, o) AS alias FROM m WHERE lower(name) = 'new x' GROUP BY 1),
af AS (SELECT s_suppkey AS company_id, CASE WHEN s_suppkey % 3 > 0 OR s_suppkey IN (SELECT s FROM m WHERE dom = 's' || s || '.com') THEN 's' || s_suppkey || '.com' END AS domain, alias, ids FROM supplier LEFT JOIN il ON il.s = s_suppkey LEFT JOIN na ON na.s = s_suppkey)"""
