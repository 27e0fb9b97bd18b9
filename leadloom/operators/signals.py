"""Business models and commercial signals that evidence texts name, by whole-word phrases.

Each text is scanned by one pattern for a model or signal; rows are never
joined with phrases. Sums are partial before they shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text

# Fields that say nothing of a model, the fields that signals are read from, and the phrases.
NOT_MODEL_FIELDS = ("company_identity", "domain", "country", "employee_count", "employee_range", "linkedin_id", "industry")
SIGNAL_FIELDS = ("products_services", "business_model", "company_type")
MODELS = {
    "DTC": ("dtc", "d2c", "direct-to-consumer", "direct to consumer"),
    "B2C": ("b2c", "business-to-consumer", "business to consumer", "consumer-facing"),
    "B2B": ("b2b", "business-to-business", "business to business", "enterprise customers"),
    "B2B2C": ("b2b2c",),
    "MARKETPLACE": ("marketplace", "multi-vendor", "multi-sided platform"),
    "AGENCY": ("agency",),
    "CONSULTANCY": ("consultancy", "consulting"),
    "WHOLESALE": ("wholesale", "distributor", "distribution partner"),
    "RETAIL": ("retail", "storefront", "brick-and-mortar", "brick and mortar"),
    "SERVICE": ("service provider", "professional services", "managed service"),
}
SIGNALS = {
    "DTC": ("direct-to-consumer", "direct to consumer", "dtc brand", "d2c brand"),
    "ECOMMERCE": ("ecommerce store", "e-commerce store", "online store", "online shop"),
    "SHOPIFY": ("built on shopify", "shopify store", "shopify-powered", "runs on shopify", "uses shopify"),
    "META_ADVERTISING": ("meta advertising", "facebook ads", "instagram ads", "runs meta ads", "meta ad campaigns"),
    "TIKTOK_ADVERTISING": ("tiktok ads", "tiktok advertising", "tiktok ad campaigns"),
    "GOOGLE_ADVERTISING": ("google ads", "google advertising", "google ad campaigns"),
    "INFLUENCER_MARKETING": ("influencer marketing", "influencer partnerships", "influencer campaigns"),
    "CREATOR_MARKETING": ("creator marketing", "creator partnerships", "creator campaigns"),
    "EMAIL_CRM": ("email marketing", "crm platform", "email and crm", "email/crm"),
    "SUBSCRIPTION": ("subscription model", "subscription service", "subscription-based", "recurring subscription"),
    "REPEAT_PURCHASES": ("repeat purchase", "repeat customers", "repeat buyers"),
    "PERFORMANCE_MARKETING": ("performance marketing",),
    "GROWTH_MARKETING": ("growth marketing",),
    "RETAIL_EXPANSION": ("retail expansion", "expanding into retail", "expanding to retail"),
    "INTERNATIONAL_EXPANSION": ("international expansion", "expanding internationally", "global expansion"),
    "NEW_PRODUCT_LAUNCH": ("new product launch", "launched a new product", "new product line"),
    "FUNDING": ("raised funding", "series a", "series b", "seed funding", "venture funding"),
    "MARKETING_HIRING": ("hiring a marketing", "marketing hire", "hiring for marketing"),
    "DISTRIBUTION_PARTNERSHIP": ("distribution partnership", "distribution deal", "distribution agreement"),
    "CONSUMER_BRAND": ("consumer brand", "consumer-facing brand"),
}
DENIALS = {
    "SUBSCRIPTION": ("no subscription", "not a subscription", "one-time purchase only", "non-subscription"),
    "ECOMMERCE": ("no online store", "not sold online", "wholesale only, no online store"),
}


def _says(text: Column, phrases: tuple[str, ...]) -> Column:
    return text.rlike(r"(?U)\b(?:" + "|".join(re.escape(p) for p in phrases) + r")\b")


def value_text(value_json: Column) -> Column:
    """The text of a JSON value: a string as it is, a list's items or an object's values joined by spaces, anything else as written."""
    items = F.from_json(value_json, "array<string>")
    fields = F.map_values(F.from_json(value_json, "map<string,string>"))
    start = F.substring(F.ltrim(value_json), 1, 1)
    return F.when(start == "[", F.array_join(items, " ")).when(start == "{", F.array_join(fields, " ")).when(start == '"', F.get_json_object(F.concat(F.lit('{"v":'), value_json, F.lit("}")), "$.v")).otherwise(value_json)


def _phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    """The first of the phrases that a text says, as it stands there; null if none."""
    return F.nullif(F.regexp_extract(text, r"(?U)\b(" + "|".join(re.escape(p) for p in phrases) + r")\b", 1), F.lit(""))


def model_mentions(evidence: DataFrame) -> DataFrame:
    """(company_id, model, id, phrase) for each row that names a model; those of a company type that others contradict have model null: conflicting rows.

    Ids stay in rows: a model may be named any number of times.
    """
    text, is_type = F.lower(clean_text(F.col("text"))), F.coalesce(F.col("field") == "company_type", F.lit(False))
    usable = ~F.coalesce(F.col("field"), F.lit("")).isin(*NOT_MODEL_FIELDS)
    rows = evidence.where(usable).select("company_id", "id", text.alias("text"), is_type.alias("is_type"))
    types = rows.where("is_type").groupBy("company_id").agg((F.min("text") != F.max("text")).alias("split"))
    named = F.array(*[F.struct(F.lit(m).alias("model"), _phrase(F.col("text"), MODELS[m]).alias("phrase")) for m in sorted(MODELS)])
    rows = rows.join(types, "company_id", "left").withColumn("clash", F.col("is_type") & F.coalesce("split", F.lit(False)))
    told = rows.where("not clash").select("company_id", "id", F.inline(F.filter(named, lambda n: n["phrase"].isNotNull()))).select("company_id", "model", "id", "phrase")
    return told.unionByName(rows.where("clash").select("company_id", F.lit(None).cast("string").alias("model"), "id", F.lit(None).cast("string").alias("phrase")))


def signal_mentions(evidence: DataFrame) -> DataFrame:
    """(company_id, signal, id, says, phrase) for each row that affirms or denies a signal."""
    def told(s: str) -> Column:
        no = _phrase(F.col("text"), DENIALS[s]) if s in DENIALS else F.lit(None).cast("string")
        return F.struct(F.lit(s).alias("signal"), no.isNull().alias("says"), F.coalesce(no, _phrase(F.col("text"), SIGNALS[s])).alias("phrase"))

    rows = evidence.where(F.col("field").isin(*SIGNAL_FIELDS)).select("company_id", "id", F.lower(clean_text(F.col("text"))).alias("text"))
    return rows.select("company_id", "id", F.inline(F.filter(F.array(*map(told, SIGNALS)), lambda n: n["phrase"].isNotNull())))


def business_models(evidence: DataFrame) -> DataFrame:
    """One row a company of ``evidence`` (company_id, field, text): primary, models (sorted), status, confidence.

    Two different company types conflict and then say nothing. No model:
    UNKNOWN; one: that; more: HYBRID. MEDIUM if a model has two rows or more.
    Null texts and fields name nothing.
    """
    text = F.lower(clean_text(F.col("text")))
    usable = ~F.coalesce(F.col("field"), F.lit("")).isin(*NOT_MODEL_FIELDS)
    is_type = F.coalesce(F.col("field") == "company_type", F.lit(False))
    rows = evidence.select("company_id", text.alias("text"), is_type.alias("is_type"), usable.alias("usable"))
    hit = lambda m: F.coalesce(F.col("usable") & _says(F.col("text"), MODELS[m]), F.lit(False))
    sums = [F.count(F.when(hit(m) & cond, 1)).alias(f"{m}_{k}") for m in MODELS for k, cond in (("t", F.col("is_type")), ("o", ~F.col("is_type")))]
    typed = F.when(F.col("is_type"), F.col("text"))
    made = rows.groupBy("company_id").agg((F.min(typed) != F.max(typed)).alias("split"), *sums).withColumn("split", F.coalesce("split", F.lit(False)))
    n = {m: F.col(f"{m}_o") + F.when(F.col("split"), 0).otherwise(F.col(f"{m}_t")) for m in MODELS}
    models = F.array_compact(F.array(*[F.when(n[m] > 0, F.lit(m)) for m in sorted(MODELS)]))
    most = F.greatest(*n.values())
    made = made.select("company_id", "split", models.alias("models"), most.alias("most"))
    k = F.size("models")
    primary = F.when(k == 0, "UNKNOWN").when(k == 1, F.get("models", F.lit(0))).otherwise("HYBRID")
    status = F.when(k > 0, "CLASSIFIED").when(F.col("split"), "CONFLICTING_EVIDENCE").otherwise("INSUFFICIENT_EVIDENCE")
    confidence = F.when(k == 0, "UNKNOWN").when(F.col("most") >= 2, "MEDIUM").otherwise("LOW")
    return made.select("company_id", primary.alias("primary"), "models", status.alias("status"), confidence.alias("confidence"))


def commercial_signals(evidence: DataFrame) -> DataFrame:
    """One row for each company and signal that its ``evidence`` affirms or denies.

    Takes company_id, field, text, confidence, provider, retrieved_at and id.
    A denial in a text wins over what it affirms. Signals that nothing
    mentions are absent.
    """
    text = F.lower(clean_text(F.col("text")))

    def verdict(s: str) -> Column:
        yes = F.when(_says(F.col("text"), SIGNALS[s]), True)
        return F.when(_says(F.col("text"), DENIALS[s]), False).otherwise(yes) if s in DENIALS else yes

    rows = evidence.where(F.col("field").isin(*SIGNAL_FIELDS)).withColumn("text", text)
    told = rows.withColumn("v", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), verdict(s).alias("says")) for s in SIGNALS]))).where("v.says is not null")
    made = told.groupBy("company_id", "v.signal").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("v.says"), 1)).alias("n_positive"), F.max("confidence").alias("top"),
        F.min("retrieved_at").alias("first_seen"), F.max("retrieved_at").alias("last_seen"), F.array_sort(F.collect_set("provider")).alias("providers"),
    )
    conflict = (F.col("n_positive") > 0) & (F.col("n_positive") < F.col("n"))
    status = F.when(conflict, "CONFLICT").when((F.col("n") >= 2) | F.col("top").isin("MEDIUM", "HIGH"), "SUPPORTED").otherwise("INSUFFICIENT")
    confidence = F.when(conflict, "UNKNOWN").when(F.col("n_positive") >= 2, "MEDIUM").otherwise("LOW")
    return made.select("company_id", "signal", status.alias("status"), confidence.alias("confidence"), "n_positive", "n", "first_seen", "last_seen", "providers")
