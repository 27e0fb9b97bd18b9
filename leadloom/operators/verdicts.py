"""Verdicts on leads: reading them, what they may decide, reviews, and how ready a lead is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each kind of answer holds, as (kind, required, most characters), what its verdict may be, and which lists cite evidence.
DECISIONS = ("GOOD_FIT", "WEAK_FIT", "NOT_FIT", "HOLD")
TEXTS = ("list", False, None)
QUALIFICATION = {
    "decision": (DECISIONS, True, None), "confidence": ("number", True, None), "reason_codes": TEXTS, "summary": ("text", True, 2000), "supporting_evidence_ids": TEXTS, "risk_evidence_ids": TEXTS,
    "missing_evidence": TEXTS, "commercial_fit_explanation": ("text", False, 2000), "hard_rule_acknowledgement": ("text", False, 1000), "uncertainties": TEXTS,
}
ADVERSARIAL = {
    "adversarial_result": (("SURVIVES", "WEAKENED", "DISPROVED", "HOLD"), True, None), "confidence": ("number", True, None), "contradictions": TEXTS, "risk_codes": TEXTS, "supporting_evidence_ids": TEXTS,
    "contradicting_evidence_ids": TEXTS, "unsupported_claims": TEXTS, "missing_evidence": TEXTS, "reasoning_summary": ("text", True, 2000), "recommendation": ("text", False, 1000),
}
PRESCREEN = {"verdict": (("RELEVANT", "NOT_RELEVANT"), True, None), "reason": ("text", True, 500), "confidence": ("number", True, None)}
FEEDBACK_OF = {"ACCEPT": "GOOD_FIT", "REJECT": "NOT_FIT", "HOLD": "HOLD"}


def _fits(v: Column, name: str, kind, required: bool, most: int | None) -> Column:
    """Whether a field of a parsed answer is of its kind; one that is left out is fine unless it is required, a null never is."""
    own = F.try_variant_get(v, f"$.{name}", "variant")
    shape = F.schema_of_variant(own)
    if kind == "list":
        good = shape.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.coalesce(F.exists(F.try_variant_get(v, f"$.{name}", "array<string>"), lambda x: x.isNull()), F.lit(False))
    elif kind == "number":
        good = F.coalesce(F.try_variant_get(v, f"$.{name}", "double").between(0, 100), F.lit(False)) & ~shape.startswith("ARRAY") & ~shape.startswith("OBJECT")
    elif kind == "text":
        n = F.length(F.try_variant_get(v, f"$.{name}", "string"))
        good = (shape == "STRING") & (n <= most) & ((n >= 1) if required else F.lit(True))
    else:
        good = (shape == "STRING") & F.try_variant_get(v, f"$.{name}", "string").isin(*kind)
    return F.when(shape.isNull(), F.lit(not required)).otherwise(F.coalesce(good, F.lit(False)))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse(raw: Column, known_ids: Column, spec: dict = QUALIFICATION) -> Column:
    """struct(status, verdict, confidence, evidence_ids) of a stored answer.

    Blank text is EMPTY_RESPONSE, text that is no JSON MALFORMED_OUTPUT, JSON
    of another form SCHEMA_INVALID (a field too many, too few or outside its
    range), and one that cites an id outside ``known_ids`` (null: none)
    INVALID_EVIDENCE_IDS; none of these has a verdict. Else SUCCESS.
    """
    verdict, empty = next(iter(spec)), F.array().cast("array<string>")
    keys = F.json_object_keys(raw)
    known_keys = keys.isNotNull() & (F.size(F.array_except(keys, F.array(*map(F.lit, spec)))) == 0)
    blank = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\s+", " ")) == ""

    def read(v: Column) -> Column:
        valid = known_keys
        for name, (kind, required, most) in spec.items():
            valid = valid & _fits(v, name, kind, required, most)
        cited = [F.coalesce(F.try_variant_get(v, f"$.{n}", "array<string>"), empty) for n in spec if n.endswith("_evidence_ids")]
        ids = F.array_distinct(F.concat(*cited)) if cited else empty
        return F.struct(F.coalesce(valid, F.lit(False)).alias("valid"), ids.alias("ids"), F.try_variant_get(v, f"$.{verdict}", "string").alias("verdict"), F.try_variant_get(v, "$.confidence", "double").alias("confidence"), v.isNull().alias("broken"))

    def told(x: Column) -> Column:
        unknown = F.size(F.array_except(x["ids"], F.coalesce(known_ids, empty))) > 0
        status = F.when(blank, "EMPTY_RESPONSE").when(x["broken"], "MALFORMED_OUTPUT").when(~x["valid"], "SCHEMA_INVALID").when(unknown, "INVALID_EVIDENCE_IDS").otherwise("SUCCESS")
        fine = ~blank & ~x["broken"] & x["valid"] & ~unknown
        return F.struct(status.alias("status"), F.when(fine, x["verdict"]).alias("verdict"), F.when(fine, x["confidence"]).alias("confidence"), F.when(fine, x["ids"]).alias("evidence_ids"))

    return _once(_once(F.try_parse_json(raw), read), told)


def prescreen(page_text: Column, page_state: Column, snippet: Column, answer: Column) -> Column:
    """struct(status, verdict, content_source): what a candidate is judged by, and how.

    The page's text if it was fetched in order, else the search snippet, else
    SKIPPED_NO_CONTENT. No answer is PROVIDER_UNAVAILABLE. Whatever goes wrong,
    the verdict is null and the candidate goes on.
    """
    text = F.when(page_state == "ok", F.nullif(page_text, F.lit("")))
    short = F.nullif(F.trim(F.coalesce(snippet, F.lit(""))), F.lit(""))
    source = F.when(text.isNotNull(), "homepage").when(short.isNotNull(), "search_snippet").otherwise("none")
    read = parse(answer, F.lit(None).cast("array<string>"), PRESCREEN)
    status = F.when(source == "none", "SKIPPED_NO_CONTENT").when(read["status"] == "EMPTY_RESPONSE", "PROVIDER_UNAVAILABLE").otherwise(read["status"])
    return F.struct(status.alias("status"), F.when(status == "SUCCESS", read["verdict"]).alias("verdict"), source.alias("content_source"))


def screened_out(verdict: Column) -> Column:
    """Only a verdict that says so rejects."""
    return F.coalesce(verdict == "NOT_RELEVANT", F.lit(False))


def gate(hard: Column, match_type: Column) -> Column:
    """struct(status, decision) of leads that need no verdict; null where one is to be fetched."""
    made = lambda s, d: F.struct(F.lit(s).alias("status"), F.lit(d).alias("decision"))
    return F.when(hard == "FAIL", made("HARD_REJECTED", "REJECT")).when(hard == "HOLD", made("HARD_HOLD", "HOLD")).when((hard == "PASS") & (match_type == "structured"), made("STRUCTURED_MATCH_TRUSTED", "GOOD_FIT"))


def adversarial_gate(hard: Column) -> Column:
    """struct(status, result) of leads that no second look can change; null where one is to be taken."""
    return F.when(hard.isin("FAIL", "HOLD"), F.struct(F.lit("HARD_BLOCKED").alias("status"), F.lit("NOT_EXECUTED").alias("result")))


def feedback_of_review(decision: Column) -> Column:
    """The feedback that a review stands for; a duplicate is none."""
    return F.create_map(*[F.lit(x) for p in FEEDBACK_OF.items() for x in p])[decision]


def review(decision: Column, hard: Column, reasons: Column) -> Column:
    """struct(decision, status, reasons): a person cannot accept what a hard rule rejects."""
    blocked = F.coalesce((decision == "ACCEPT") & (hard == "FAIL"), F.lit(False))
    added = F.array_union(F.coalesce(reasons, F.array().cast("array<string>")), F.array(F.lit("HARD_ICP_FAILURE")))
    return F.struct(
        F.when(blocked, "REJECT").otherwise(decision).alias("decision"), F.when(blocked, "BLOCKED_BY_HARD_FAIL").otherwise("RECORDED").alias("status"),
        F.when(blocked, added).otherwise(reasons).alias("reasons"),
    )


def feedback_errors(decision: Column, reasons: Column, lead_ref: Column, reviewer: Column) -> Column:
    """What is wrong with a feedback row, as a list: empty for a valid one. Codes are judged without the blanks around them; case does not tell them apart."""
    codes = F.transform(F.coalesce(reasons, F.array().cast("array<string>")), lambda x: F.trim(x))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.array_compact(F.array(
        F.when(blank(lead_ref), "LEAD_REF_BLANK"), F.when(blank(reviewer), "REVIEWER_BLANK"),
        F.when(~F.coalesce(decision.isin(*DECISIONS), F.lit(False)), "DECISION_UNKNOWN"),
        F.when(~F.forall(codes, lambda c: F.coalesce(c.rlike(r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$"), F.lit(False))), "REASON_CODE_FORM"),
        F.when(F.size(F.array_distinct(F.transform(codes, F.lower))) < F.size(codes), "REASON_CODE_REPEATED"), F.when((decision != "GOOD_FIT") & (F.size(codes) == 0), "REASON_CODE_MISSING"),
    ))


def readiness(hard: Column, has_evidence: Column, conflicts: Column, missing: Column, verification: Column, decision: Column, adversarial: Column, human: Column, duplicate: Column) -> Column:
    """struct(level, reasons): first match wins; the codes after the first say what else is known."""
    conflict, lacks = (F.coalesce(F.size(x), F.lit(0)) > 0 for x in (conflicts, missing))
    no_data = hard.isNull() & ~has_evidence
    opened = verification.isin("UNRESOLVED", "HOLD")
    passed = ~no_data & ~conflict & (hard == "PASS")
    level = (
        F.when(no_data, "UNKNOWN").when(conflict, "CONFLICTED").when(hard.isin("FAIL", "HOLD"), "INSUFFICIENT_EVIDENCE")
        .when(hard == "PASS", F.when(lacks | F.coalesce(opened, F.lit(False)), "PARTIALLY_VERIFIED").otherwise("VERIFIED")).otherwise("INSUFFICIENT_EVIDENCE")
    )
    main = F.when(no_data, "NO_PIPELINE_DATA").when(conflict, "EVIDENCE_CONFLICTS_PRESENT").when(hard.isin("FAIL", "HOLD", "PASS"), F.concat(F.lit("HARD_RULE_"), hard)).otherwise("HARD_RULE_UNKNOWN")
    disagree = ((decision == "GOOD_FIT") & adversarial.isin("DISPROVED", "WEAKENED")) | ((decision == "NOT_FIT") & (adversarial == "SURVIVES"))
    reasons = F.array_compact(F.array(
        main, F.when(passed, F.when(lacks, "CRITICAL_FIELDS_MISSING").otherwise("CRITICAL_FIELDS_FULLY_SUPPORTED")), F.when(passed & ~lacks & opened, "VERIFICATION_UNRESOLVED"),
        F.when(decision.isNull() & (hard == "PASS"), "QUALIFICATION_MISSING"), F.when(disagree, "QUALIFICATION_ADVERSARIAL_DISAGREEMENT"),
        F.when(human == "ACCEPT", "HUMAN_ACCEPTED").when(human == "REJECT", "HUMAN_REJECTED"), F.when(duplicate, "DUPLICATE_OCCURRENCE"),
    ))
    return F.struct(level.alias("level"), reasons.alias("reasons"))


def outcome(duplicate: Column, self_match: Column, hard: Column, decision: Column) -> Column:
    """What became of a batch item; a lead that only matches itself is no duplicate."""
    return (
        F.when(F.coalesce(duplicate & ~self_match, F.lit(False)), "DUPLICATE").when(hard == "FAIL", "REJECTED").when(hard == "HOLD", "HELD")
        .when(decision.isin("GOOD_FIT", "WEAK_FIT"), "ACCEPTED").when(decision == "NOT_FIT", "REJECTED").otherwise("HELD")
    )


def batch_counts(items: DataFrame, batch: str) -> DataFrame:
    """For each batch: items by outcome, and different leads among the accepted."""
    n = [F.count(F.when(F.col("outcome") == o, 1)).alias(f"n_{o.lower()}") for o in ("ACCEPTED", "REJECTED", "HELD", "DUPLICATE")]
    return items.groupBy(batch).agg(F.count("*").alias("n_items"), *n, F.count_distinct(F.when(F.col("outcome") == "ACCEPTED", F.col("lead_id"))).alias("n_leads"))


def run_status(calls: DataFrame, run: str) -> DataFrame:
    """For each run over ``calls`` (ok boolean, null: failed): COMPLETED, PARTIAL_FAILURE or FAILED."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return calls.groupBy(run).agg(F.when(F.bool_and(ok), "COMPLETED").when(F.bool_or(ok), "PARTIAL_FAILURE").otherwise("FAILED").alias("status"))


def batch_usage(items: DataFrame, batch: str) -> DataFrame:
    """For each batch of ``items`` (provider_id of the sighting, fetched, prescreen_status): whether any data is a mock's, pages fetched, and answers asked for."""
    asked = F.col("prescreen_status").isNotNull() & (F.col("prescreen_status") != "SKIPPED_NO_CONTENT")
    n = lambda c: F.count(F.when(c, 1))
    return items.groupBy(batch).agg(F.coalesce(F.bool_or(F.col("provider_id").startswith("mock-")), F.lit(False)).alias("used_mock"), n(F.col("fetched")).alias("n_fetched"), n(asked).alias("n_asked"))


def provider_usage(calls: DataFrame, keys: list[str], prices: dict[str, float]) -> DataFrame:
    """For each key of ``calls`` (provider, ok, n_rows): calls, failures, rows and their price; a provider without a price is free."""
    price = F.coalesce(F.create_map(*[F.lit(x) for p in prices.items() for x in p])[F.col("provider")], F.lit(0.0))
    made = calls.groupBy(*keys, "provider").agg(F.count("*").alias("n_calls"), F.count(F.when(~F.coalesce("ok", F.lit(False)), 1)).alias("n_failed"), F.sum(F.coalesce("n_rows", F.lit(0))).cast("long").alias("n_rows"))
    return made.withColumn("spend", F.col("n_rows") * price)
