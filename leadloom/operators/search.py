"""What stored search results and vendor answers say of companies and people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import email_confidence, normalize_domain, profile_id

# Size buckets; hosts that are nobody's homepage; paths of directories; words that tell nothing; what block pages say.
SIZES = (("1-10", 1, 10), ("11-50", 11, 50), ("51-200", 51, 200), ("201-500", 201, 500), ("501-1000", 501, 1000), ("1001-5000", 1001, 5000), ("5001-10000", 5001, 10000), ("10001+", 10001, None))
NO_HOMEPAGE = (
    "linkedin.com", "crunchbase.com", "ycombinator.com", "facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com", "wikipedia.org", "bloomberg.com", "g2.com", "glassdoor.com", "indeed.com", "owler.com",
    "zoominfo.com", "pitchbook.com", "jobs.lever.co", "boards.greenhouse.io", "leadiq.com", "rocketreach.co", "cbinsights.com", "tracxn.com", "squarepeg.vc", "mapquest.com", "samplefocus.com", "extruct.ai",
    "glnkco.com", "signalhire.com", "apollo.io", "cision.com", "dnb.com", "manta.com", "buzzfile.com", "zippia.com", "comparably.com", "craft.co", "theorg.com", "wellfound.com", "angel.co", "builtin.com", "clutch.co",
    "producthunt.com",
)
DIRECTORY = r"(?i)^/(?:company|companies|organization|organizations|org|profile|profiles|people|person|employee|employees|business|businesses|listing|listings|directory|firm|firms|b|biz)/"
STOPWORDS = ("the", "a", "an", "and", "or", "for", "of", "in", "on", "to", "is", "are", "we", "our", "with", "at", "by", "from", "your", "that", "this", "it", "as", "be")
BLOCKED = r"(?i)you have been blocked|unable to access crunchbase\.com|error 403[:\s]|forbidden|requiring captcha"


def size_buckets(low: Column, high: Column) -> Column:
    """The labels of all size buckets that overlap a range; null without bounds or if they are reversed."""
    least = F.coalesce(low, F.lit(0))
    hits = F.array_compact(F.array(*[F.when((F.lit(True) if b is None else F.lit(b) >= least) & (high.isNull() | (high >= a)), label) for label, a, b in SIZES]))
    return F.when((low.isNotNull() | high.isNotNull()) & (high.isNull() | (least <= high)) & (F.size(hits) > 0), hits)


def url_host(url: Column) -> Column:
    """The host in lower case, without www and port; null if there is none."""
    found = F.regexp_extract(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(found), r"^www\.", ""), F.lit(""))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://[^/]+(/.*)?$", 1)


def _at(host: Column, site: str) -> Column:
    return (host == site) | host.endswith("." + site)


def directory_result(url: Column, title: Column) -> Column:
    """struct(external_id, name) of a company's page in a directory of companies or of jobs; null for listings and all other pages."""
    host, path, title = url_host(url), url_path(url), F.coalesce(title, F.lit(""))
    blank = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), other)
    profile = F.regexp_extract(path, r"^/companies/([^/?#]+)/?$", 1)
    listed = F.regexp_extract(path, r"^/organization/([^/?#]+)/?$", 1)
    job = F.regexp_extract(path, r"^/([^/?#]+)/", 1)
    made = lambda kind, slug, name: F.when(slug != "", F.struct(F.concat(F.lit(kind + ":"), slug).alias("external_id"), name.alias("name")))
    return (
        F.when(_at(host, "ycombinator.com"), F.when(~path.rlike(r"(?i)^/companies/industry(?:/|$)"), made("yc", profile, blank(F.regexp_extract(F.trim(F.regexp_replace(title, r"(?i)\s*[|\-]\s*Y Combinator\s*$", "")), r"^([^:|]*)", 1), profile))))
        .when(_at(host, "crunchbase.com"), made("crunchbase", listed, blank(F.regexp_replace(title, r"(?i)\s*-\s*Crunchbase Company Profile.*$", ""), listed)))
        .when(_at(host, "jobs.lever.co"), made("lever", job, blank(F.regexp_extract(F.trim(title), r"^([^|–—-]*)", 1), job)))
        .when(_at(host, "boards.greenhouse.io"), made("greenhouse", job, blank(F.initcap(F.trim(F.translate(job, "-_", "  "))), job)))
    )


def is_block_page(content: Column) -> Column:
    return F.coalesce(content.rlike(BLOCKED), F.lit(False))


def may_be_homepage(url: Column) -> Column:
    """Whether a result's host and path may be a company's own: no directory, network or job board."""
    host = url_host(url)
    suffixes = "|".join(h.replace(".", r"\.") for h in NO_HOMEPAGE)
    return host.isNotNull() & ~host.rlike(rf"(?:^|\.)(?:{suffixes})$") & ~url_path(url).rlike(DIRECTORY)


def significant_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS)))


def homepages(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """(candidate_id, domain): of each candidate the first of its results that is its homepage.

    ``candidates`` has candidate_id, name and description; ``results``
    candidate_id, position, url, title and content. A homepage shares two
    significant words with the description, words of the name not counting.
    Candidates without one are absent.
    """
    c = F.col
    own = candidates.select("candidate_id", significant_words(c("name")).alias("named"), significant_words(c("description")).alias("said"))
    rows = results.where(may_be_homepage(c("url"))).join(own, "candidate_id")
    said = F.array_except("said", "named")
    shared = F.array_intersect(said, F.array_except(significant_words(F.concat_ws(" ", "title", "content")), "named"))
    good = rows.where((F.size(said) > 0) & (F.size(shared) >= 2)).select("candidate_id", "position", normalize_domain(url_host(c("url"))).alias("domain"))
    return good.where("domain is not null").groupBy("candidate_id").agg(F.min_by("domain", F.struct("position", "domain")).alias("domain"))


# For each form of stored answer where its rows, their id and their name are, and what each field is read from, as (path, kind).
FORMS = {
    "people_search": ("$.items", "$.id", "$.name", {"current_title": ("$.current_positions[0].role", "text"), "company_association": ("$.current_positions[0].company", "text")}),
    "person_match": ("$.person", "$.id", "$.name", {"current_title": ("$.title", "text"), "email": ("$.email", "text"), "email_status": ("$.email_status", "text"), "linkedin_url": ("$.linkedin_url", "text"), "organization_name": ("$.organization_name", "text")}),
    "registry": ("$.results.bindings", None, "$.itemLabel.value", {"industry": ("$.industryLabel.value", "text"), "country": ("$.countryLabel.value", "text"), "founded_year": ("$.inception.value", "year")}),
    "filings": (None, None, None, {"industry": ("$.sicDescription", "text"), "country": ("$.addresses.business.stateOrCountryDescription", "text")}),
    "email_check": (None, None, None, {"email_is_disposable": ("$.is_disposable_email.value", "flag"), "email_is_role_address": ("$.is_role_email.value", "flag"), "email_is_catchall": ("$.is_catchall_email.value", "flag")}),
    "phone_check": (None, None, None, {"phone_is_valid": ("$.valid", "flag"), "phone_line_type": ("$.type", "word"), "phone_carrier": ("$.carrier", "word")}),
}
PROFILE_HOST = "https://www.linkedin.com/"


def _value(row: Column, path: str, kind: str) -> Column:
    """What a path of a parsed row holds, as text: a flag only if it is a boolean, a word only if it is a string, of a date the year; blanks are nothing."""
    text = F.nullif(F.try_variant_get(row, path, "string"), F.lit(""))
    if kind == "text":
        return text
    if kind == "year":
        return F.nullif(F.regexp_extract(text, r"^(\d{4})", 1), F.lit(""))
    held = F.schema_of_variant(F.try_variant_get(row, path, "variant"))
    return F.when(held == ("BOOLEAN" if kind == "flag" else "STRING"), text)


def _profile_link(row: Column) -> Column:
    """A person's public address: the one given, else of the identifier, else the profile's if it is public."""
    given, handle, other = (_value(row, f"$.{n}", "text") for n in ("public_profile_url", "public_identifier", "profile_url"))
    return F.coalesce(given, F.concat(F.lit(PROFILE_HOST + "in/"), handle), F.when(F.contains(other, F.lit("linkedin.com/in/")), other))


def vendor_facts(answers: DataFrame) -> DataFrame:
    """(entity_id, provider, external_id, name, field, value) for each fact that a stored answer (entity_id, provider, form, body as JSON) states.

    Each body is parsed once, and read by the table of its form. A people
    search gives a record a person who has an id and a name; a registry
    answer the first value of each field in its rows. What is absent or blank
    stays absent; bodies that are no JSON and forms that are not known give
    nothing. An answer without a record's id goes by its entity.
    """
    c = F.col
    known = answers.where(c("form").isin(*FORMS)).select("entity_id", "provider", "form", F.explode(F.array(F.try_parse_json("body"))).alias("v")).where(c("v").isNotNull())
    out = None
    for form, (rows, key, name, fields) in FORMS.items():
        own = known.where(c("form") == form)
        if form == "people_search":
            own = own.select("entity_id", "provider", F.explode(F.try_variant_get("v", rows, "array<variant>")).alias("v"))
            link = profile_id(F.create_map(F.lit("linkedin_id"), F.lit(None).cast("string"), F.lit("linkedin_url"), _profile_link(c("v"))))
            read = {f: _value(c("v"), *how) for f, how in fields.items()} | {"linkedin_id": link, "linkedin_url": F.concat(F.lit(PROFILE_HOST), link)}
        elif form == "registry":
            own = own.select("entity_id", "provider", F.try_variant_get("v", rows, "array<variant>").alias("v"))
            first = lambda path, kind: F.get(F.filter(F.transform("v", lambda x: _value(x, path, kind)), lambda x: x.isNotNull()), F.lit(0))
            read = {f: first(*how) for f, how in fields.items()}
        else:
            if rows:
                own = own.select("entity_id", "provider", F.try_variant_get("v", rows, "variant").alias("v")).where(c("v").isNotNull())
            read = {f: _value(c("v"), *how) for f, how in fields.items()}
        ident = _value(c("v"), key, "text") if key else F.lit(None).cast("string")
        called = F.lit(None).cast("string") if not name else first(name, "text") if form == "registry" else _value(c("v"), name, "text")
        facts = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), x.alias("value")) for f, x in read.items()]), lambda i: i["value"].isNotNull())
        if form == "people_search":
            own = own.where(ident.isNotNull() & called.isNotNull())
        made = own.select("entity_id", "provider", F.coalesce(ident, c("entity_id").cast("string")).alias("external_id"), called.alias("name"), F.inline(facts))
        out = made if out is None else out.unionByName(made)
    return out


def stated_confidence(facts: DataFrame) -> DataFrame:
    """Adds confidence to facts (entity_id, provider, field, value): an e-mail address is worth what the same provider's email_status says, other facts are UNKNOWN."""
    keys = ["entity_id", "provider"]
    told = facts.where(F.col("field") == "email_status").groupBy(*keys).agg(F.max("value").alias("__status"))
    rows = facts.join(told, keys, "left")
    return rows.select(*facts.columns, F.when(F.col("field") == "email", email_confidence(F.col("__status"))).otherwise("UNKNOWN").alias("confidence"))
