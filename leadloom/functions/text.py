"""Column functions that bring names, domains, titles, places and sizes to a comparable form."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Legal suffixes, countries with their aliases, title abbreviations, words left out of titles.
LEGAL_SUFFIXES = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "llp", "plc", "gmbh", "srl", "sa", "bv", "ag")
COUNTRIES = {
    "US": ("United States", "USA", "U.S.", "U.S.A.", "United States of America"),
    "GB": ("United Kingdom", "UK", "U.K.", "Great Britain"),
    "CA": ("Canada",), "AU": ("Australia",), "NZ": ("New Zealand",), "DE": ("Germany", "Deutschland"), "FR": ("France",),
    "NL": ("Netherlands", "The Netherlands", "Holland"), "IE": ("Ireland",), "ES": ("Spain",), "IT": ("Italy",), "SE": ("Sweden",),
    "NO": ("Norway",), "DK": ("Denmark",), "FI": ("Finland",), "CH": ("Switzerland",), "AT": ("Austria",), "BE": ("Belgium",),
    "PT": ("Portugal",), "PL": ("Poland",), "IN": ("India",), "SG": ("Singapore",), "JP": ("Japan",), "CN": ("China",),
    "BR": ("Brazil",), "MX": ("Mexico",), "ZA": ("South Africa",), "AE": ("United Arab Emirates", "UAE"), "IL": ("Israel",),
}
TITLE_WORDS = {
    "ceo": "chief executive officer", "cfo": "chief financial officer", "cmo": "chief marketing officer", "cto": "chief technology officer",
    "coo": "chief operating officer", "cpo": "chief product officer", "cro": "chief revenue officer", "chro": "chief human resources officer",
    "ciso": "chief information security officer", "cio": "chief information officer", "evp": "executive vice president",
    "svp": "senior vice president", "avp": "assistant vice president", "vp": "vice president", "dir": "director", "mgr": "manager",
    "sr": "senior", "jr": "junior",
}
TITLE_STOPWORDS = ("of", "and", "the", "&")
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")


def clean_text(c: Column) -> Column:
    """Trimmed, with every run of Unicode white space as one space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_domain(c: Column) -> Column:
    """Lower case, without scheme, www, path, query and trailing dots; nothing left: null."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(clean_text(c)), r"^https?://", ""), r"^www\.", "")
    return _or_null(F.regexp_replace(F.substring_index(F.substring_index(bare, "/", 1), "?", 1), r"\.+$", ""))


def normalize_company_name(c: Column) -> Column:
    """Lower case, without dots, commas and legal suffixes at the end; nothing left: null."""
    bare = clean_text(F.regexp_replace(F.lower(clean_text(c)), "[.,]", ""))
    return _or_null(F.trim(F.regexp_replace(bare, rf"((^|\s)({'|'.join(LEGAL_SUFFIXES)}))+$", "")))


def normalize_person_name(c: Column) -> Column:
    return _or_null(F.lower(clean_text(c)))


def country_code(c: Column) -> Column:
    """The ISO code of a country's name, code or alias; anything else: null. Regions never expand."""
    pairs = [x for code, names in COUNTRIES.items() for name in (code, *names) for x in (F.lit(name.lower()), F.lit(code))]
    return F.create_map(*pairs)[F.lower(clean_text(c))]


def profile_id(attributes: Column) -> Column:
    """The profile of a person: linkedin_id, or else linkedin_url, of a map, in lower case without scheme, host and slashes at the end; nothing left: null."""
    raw = F.coalesce(_or_null(attributes["linkedin_id"]), attributes["linkedin_url"])
    bare = F.regexp_replace(F.regexp_replace(F.lower(clean_text(raw)), r"^[a-z][a-z0-9+.-]*://", ""), r"^(www\.)?linkedin\.com/", "")
    return _or_null(F.regexp_replace(bare, "/+$", ""))


@F.arrow_udf(StringType())
def _sorted_json(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True)
        except (ValueError, RecursionError):  # no JSON, or nested too deep to be read
            return text

    for part in texts:
        yield pa.array(map(one, part.to_pylist()), pa.string())


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys; text that is no JSON stays. Only objects and lists leave the JVM: other values have one form."""
    nested = F.substring(F.ltrim(c), 1, 1).isin("{", "[")
    return F.when(nested, _sorted_json(F.when(nested, c))).otherwise(F.trim(c))


def email_confidence(status: Column) -> Column:
    """What a provider's own status of an address is worth."""
    return F.when(status == "verified", "HIGH").when(status == "guessed", "LOW").otherwise("UNKNOWN")


def title_key(c: Column) -> Column:
    """A job title's words, abbreviations spelled out, connectives dropped, sorted, joined by spaces."""
    words = F.transform(F.regexp_extract_all(F.lower(clean_text(c)), F.lit(r"([a-z0-9.]+)"), 1), lambda w: F.regexp_replace(w, r"\.+$", ""))
    table = F.create_map(*[F.lit(x) for pair in TITLE_WORDS.items() for x in pair])
    spelled = F.flatten(F.transform(words, lambda w: F.split(F.coalesce(table[w], w), " ")))
    return F.array_join(F.array_sort(F.filter(spelled, lambda w: ~w.isin(*TITLE_STOPWORDS))), " ")


def employee_bucket(c: Column) -> Column:
    """struct(low, high) of "51-200" or "10001+" (high null); anything else, or low over high: null."""
    low = F.regexp_extract(c, r"^\s*(\d+)\s*(?:-\s*\d+|\+)\s*$", 1).try_cast("int")
    high = F.regexp_extract(c, r"^\s*\d+\s*-\s*(\d+)\s*$", 1).try_cast("int")
    return F.when(low.isNotNull() & (high.isNull() | (low <= high)), F.struct(low.alias("low"), high.alias("high")))


def confidence_bucket(c: Column) -> Column:
    return F.when(c.isNull(), "UNKNOWN").when(c >= 0.8, "HIGH").when(c >= 0.5, "MEDIUM").otherwise("LOW")


def split_person_name(c: Column) -> Column:
    """struct(first, last): the last word is the surname; a suffix goes with it from three words on."""
    words = F.filter(F.split(clean_text(c), " "), lambda w: w != "")
    n = F.size(words)
    suffix = (n >= 3) & F.lower(F.regexp_replace(F.element_at(words, -1), r"\.+$", "")).isin(*NAME_SUFFIXES)
    last = F.when(suffix, 2).otherwise(1)
    return F.when(
        n > 0,
        F.struct(
            F.array_join(F.slice(words, 1, F.greatest(n - last, F.lit(0))), " ").alias("first"),
            F.array_join(F.slice(words, F.greatest(n - last, F.lit(0)) + 1, last), " ").alias("last"),
        ),
    )


def preference_term(c: Column) -> Column:
    """Upper case with underscores: the form of vocabulary names."""
    return F.upper(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""))


def fingerprint(*parts: Column) -> Column:
    """Thirty-two hexadecimal digits that identify a recommendation; null parts count as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 32)
