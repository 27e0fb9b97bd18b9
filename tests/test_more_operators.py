import html
import re

from leadloom.functions.text import canonical_json
from leadloom.operators import pages as W
from leadloom.operators import scores as C
from leadloom.operators import signals as G
from leadloom.operators import tuning as U
from leadloom.operators import verdicts as V
from pyspark.sql import functions as F

KIND = "company_id string, field string, text string, confidence string, provider string, retrieved_at timestamp, id string"


def test_models_and_signals(spark):
    rows = [("a", "company_type", "B2B"), ("a", "company_type", "B2C"), ("a", "products_services", "wholesale tea"), ("b", "industry", "retail"), ("b", None, None), ("c", "company_type", "agency"), ("c", "x", "AGENCY"), ("d", "company_type", "b2b"), ("d", "company_type", "b2c")]
    rows += [("e", "business_model", "no online store, online shop"), ("e", "business_model", "online shop")]
    df = spark.createDataFrame([(*r, "LOW", "p", None, str(k)) for k, r in enumerate(rows)], KIND)
    got = {r.company_id: (r.primary, r.status, r.confidence) for r in G.business_models(df).collect()}
    assert got["a"] == ("WHOLESALE", "CLASSIFIED", "LOW") and got["b"] == ("UNKNOWN", "INSUFFICIENT_EVIDENCE", "UNKNOWN")
    assert got["c"] == ("AGENCY", "CLASSIFIED", "MEDIUM") and got["d"] == ("UNKNOWN", "CONFLICTING_EVIDENCE", "UNKNOWN")
    assert [(r.company_id, r.signal, r.status) for r in G.commercial_signals(df).collect()] == [("e", "ECOMMERCE", "CONFLICT")]
    texts = spark.createDataFrame([('["a", "b"]',), ('{"x": "c"}',), ('"d"',), ("5",), (None,)], "v string").select(G.value_text(F.col("v"))).collect()
    assert [r[0] for r in texts] == ["a b", "c", "d", "5", None]
    assert G.business_models(df.limit(0)).count() == 0 and G.commercial_signals(df.limit(0)).count() == 0


def test_scores(spark):
    one = spark.range(1)
    nothing = F.lit(None).cast("double")
    row = one.select(C.final_score(F.lit("PASS"), *map(F.lit, (100.0, 50.0, 20.0, 80.0)), nothing), C.final_score(F.lit("PASS"), *map(F.lit, (100.0, 50.0, 20.0, 80.0, 0.0))), C.final_score(F.lit("HOLD"), *map(F.lit, (100.0,) * 5)), C.final_score(F.lit("PASS"), nothing, *map(F.lit, (1.0,) * 4)), C.clamp(nothing)).first()
    assert abs(row[0] - (40 + 15 + 3 + 4) / 0.9) < 1e-9 and abs(row[1] - 62) < 1e-9 and row[2] is row[3] is row[4] is None
    none = F.array().cast("array<struct<rule:string,status:string,reason:string>>")
    ask = lambda hard, decision: C.quality(none, F.lit(hard), F.lit(100.0), F.lit(50.0), F.lit("structured"), F.lit(20), F.lit(decision).cast("string"), nothing)
    got = one.select(ask("FAIL", None).alias("a"), ask("PASS", None).alias("b"), ask("HOLD", "NOT_FIT").alias("c")).first()
    assert tuple(got.a) == (None, "REJECT") and got.b.label == "STRONG" and abs(got.b.score - (40 + 9 + 10 + 10) / 0.8) < 1e-9
    unknown = one.select(C.quality(none, F.lit("PASS"), nothing, nothing, F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("string"), nothing).alias("q")).first().q
    assert tuple(unknown) == (None, "REVIEW")
    assert got.c.label == "REVIEW" and abs(got.c.score - (69 + 0.15 * 10) / 0.95) < 1e-9


def test_verdicts(spark):
    good = '{"decision": "WEAK_FIT", "confidence": 3, "summary": "s", "supporting_evidence_ids": ["a"]}'
    raws = [
        (None, "EMPTY_RESPONSE"), (" \u00a0 ", "EMPTY_RESPONSE"), ("[", "MALFORMED_OUTPUT"), ("[1]", "SCHEMA_INVALID"), ("5", "SCHEMA_INVALID"), ("{}", "SCHEMA_INVALID"), (good.replace("3", '"high"'), "SCHEMA_INVALID"), (good.replace("3", "null"), "SCHEMA_INVALID"),
        (good.replace("3", "101"), "SCHEMA_INVALID"), (good.replace("WEAK_FIT", "REJECT"), "SCHEMA_INVALID"), (good.replace('"s"', '""'), "SCHEMA_INVALID"), (good.replace('"s"', '"' + "s" * 2001 + '"'), "SCHEMA_INVALID"), (good.replace('"summary"', '"note"'), "SCHEMA_INVALID"),
        (good.replace("}", ', "mood": "x"}'), "SCHEMA_INVALID"), (good.replace('["a"]', '"a"'), "SCHEMA_INVALID"), (good.replace('["a"]', "[1]"), "SCHEMA_INVALID"), (good.replace('["a"]', '["z"]'), "INVALID_EVIDENCE_IDS"),
        (good.replace("}", ', "risk_evidence_ids": ["y"]}'), "INVALID_EVIDENCE_IDS"), (good.replace('["a"]', "[]"), "SUCCESS"), (good, "SUCCESS"),
    ]
    df = spark.createDataFrame([(k, r) for k, (r, _) in enumerate(raws)], "k int, raw string").select("k", V.parse(F.col("raw"), F.array(F.lit("a"))).alias("v")).orderBy("k")
    assert [r.v.status for r in df.collect()] == [s for _, s in raws]
    second = '{"adversarial_result": "WEAKENED", "confidence": 50.5, "reasoning_summary": "r", "contradicting_evidence_ids": ["a"]}'
    row = spark.createDataFrame([(second,)], "raw string").select(V.parse(F.col("raw"), F.array(F.lit("a")), V.ADVERSARIAL).alias("v")).first().v
    assert tuple(row) == ("SUCCESS", "WEAKENED", 50.5, ["a"])
    gate = spark.createDataFrame([("FAIL",), ("HOLD",), ("PASS",), (None,)], "h string").select(V.adversarial_gate(F.col("h")).alias("g")).collect()
    assert [r.g and r.g.status for r in gate] == ["HARD_BLOCKED", "HARD_BLOCKED", None, None]
    nil = F.lit(None).cast("string")
    level = spark.range(1).select(V.readiness(nil, F.lit(False), F.lit(None).cast("array<string>"), F.array().cast("array<string>"), nil, nil, nil, nil, F.lit(False)).alias("r")).first().r
    assert (level.level, level.reasons) == ("UNKNOWN", ["NO_PIPELINE_DATA"])


def test_term_lists(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    row = spark.range(1).select(
        U.clean_terms(a(" A ", "a", None, "", "B  c"), 2).alias("x"), U.prioritized_terms(a("o1", "U", "o2", "c"), a("u"), a("C"), 2).alias("y"), U.term_origins(a("x"), a("X", "y")).alias("z"), U.clean_terms(F.lit(None).cast("array<string>")).alias("n"),
    ).first()
    assert (row.x, row.y, row.z, row.n) == (["A", "B c"], ["U", "c"], {"x": "user", "y": "ai"}, None)


def plain_text(raw):
    for pattern, by in ((r"(?is)<(script|style|noscript|svg|nav|footer|header)[^>]*>.*?</\1>", " "), (r"(?s)<!--.*?-->", " "), (r"<[^>]+>", " ")):
        raw = re.sub(pattern, by, raw)
    lines = [" ".join(x.split()) for x in html.unescape(raw).split("\n")]
    return "\n".join(x for x in lines if x)


def test_pages(spark):
    raws = ["<p>Tea &amp; co</p><script>x</script>\n\n <b>more</b><!-- no --> end", "", "<nav>a</nav><SVG>b</svg>", "plain", "access denied " * 40, "word " * 60]
    df = spark.createDataFrame([(k, r) for k, r in enumerate([*raws, None])], "k int, raw string").select("k", W.page_text(F.col("raw")).alias("t"), W.platforms(F.concat("raw", F.lit("/WP-includes/"))).alias("p"))
    got = df.select("k", "t", W.page_state(F.col("t")).alias("s"), "p.cms_platform").orderBy("k").collect()
    assert [r.t for r in got] == [*map(plain_text, raws), None]
    kept = df.select("k", W.page_excerpt(F.col("t"), 12).alias("e")).orderBy("k").collect()
    assert [r.e for r in kept] == [None] * 5 + ["word word wo", None]
    assert [r.s for r in got] == ["empty_content"] * 4 + ["block_page", "ok", "empty_content"]
    assert [r.cms_platform for r in got] == ["WordPress"] * 4 + [None, "WordPress", None]


def test_json_that_is_nested_too_deep_stays_as_it_is(spark):
    deep = "[" * 200_000 + "]" * 200_000
    rows = [(1, deep), (2, '{"b": 1, "a": [2]}'), (3, "{no"), (4, None)]
    got = spark.createDataFrame(rows, "k int, t string").select("k", canonical_json(F.col("t")).alias("c")).orderBy("k").collect()
    assert [r.c for r in got] == [deep, '{"a": [2], "b": 1}', "{no", None]
