"""A user's filters to profiles: from criteria, from free text, and with terms that a model proposes."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Collection, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Filters with their labels and operators; terms that free text is searched for, with what they stand for; how clauses are told apart.
CATALOG = {
    "industry": ("Industry", "in"), "geography": ("Location", "in"), "employee_range": ("Employees", "range"), "allowed_titles": ("Titles / Decision makers", "in"), "company_type": ("Company type", "in"),
    "exclusions": ("Exclusions", "not_in"), "business_model": ("Business model", "in"), "commercial_signals": ("Commercial signals", "in"), "funding": ("Funding", "in"), "hiring": ("Hiring", "in"),
    "marketing_signals": ("Marketing signals", "in"), "revenue": ("Revenue", "range"), "technology": ("Technology", "in"), "website": ("Website", "contains"), "custom": ("Custom requirement", "contains"),
}
LISTS = ("industry", "geography", "allowed_titles", "company_type", "business_model", "commercial_signals", "marketing_signals")
TERMS = {
    "industry": {"d2c": "D2C", "direct[- ]to[- ]consumer": "D2C", "fmcg": "FMCG", "healthcare": "Healthcare", "ott": "OTT Platforms", "microdrama": "Microdrama Companies", "saas": "SaaS"},
    "geography": {
        "united states": "United States", r"u\.s\.": "United States", r"\bus\b": "United States", "european union": "European Union", r"\beu\b": "European Union", "gcc": "GCC", "uk": "United Kingdom",
        "united kingdom": "United Kingdom", "canada": "Canada", "australia": "Australia", "singapore": "Singapore", "uae": "UAE", "saudi arabia": "Saudi Arabia", "qatar": "Qatar",
    },
    "allowed_titles": {
        "founder": "Founder", "co[- ]founder": "Co-Founder", "ceo": "CEO", "cmo": "CMO", "marketing head": "Marketing Head", "vp marketing": "VP Marketing", "head of growth": "Head of Growth",
        "director of marketing": "Director of Marketing", "marketing leaders?": "Marketing Head",
    },
    "funding": {"recently raised": "Recently raised", "raised funding": "Recently raised", "series [a-e]": "Recently raised"},
    "hiring": {"hiring (?:for )?marketing": "Marketing", "hiring marketing leaders": "Marketing"},
}
TRIGGER = r"\b(?:excluding|exclude[sd]?|except(?:\s+for)?|not\s+including)\b"
CLAUSE_END = r"[.;]|\bthat\s+(?:are|have|require)\b|\bwith\s+\d"
INT = r"(\d{1,3}(?:,\d{3})*|\d+)"
EMPLOYEES = rf"{INT}\s*(?:[-–—]|to)\s*{INT}\s*employees"
AMOUNTS = rf"\$?{INT}(?:\.\d+)?\s*+([kmb])?\s*+(?:[-–—]|to)\s*\$?{INT}(?:\.\d+)?\s*+([kmb])?"
REVENUE = (rf"{AMOUNTS}\s*+(?:in )?revenue", rf"revenue\s*(?:of |is |around |estimated )*{AMOUNTS}")
UNITS = {"k": 1_000, "m": 1_000_000, "b": 1_000_000_000}
REQUIREMENT = r"\w[\w\s/-]{11,}\w"
FILLERS = ("find", "with", "that", "are", "the", "for")


def project(criteria: DataFrame) -> DataFrame:
    """One row a profile: errors, the lists of hard rules and preferences, the employee range, and labelled rules.

    ``criteria`` has icp_id, pos, key, operator, terms (array), low, high,
    label and text. Lists of one key are joined in order; of several
    exclusions or ranges the last counts. Known keys without a list of their
    own become labelled preferences, ``custom`` a labelled hard rule. An
    unknown key or operator is an error, and then nothing is projected.
    """
    c, none = F.col, F.array().cast("array<string>")
    label = F.create_map(*[F.lit(x) for k, (name, _) in CATALOG.items() for x in (k, name)])[c("key")]
    allowed = F.create_map(*[F.lit(x) for k, (_, op) in CATALOG.items() for x in (k, op)])[c("key")]
    error = F.when(allowed.isNull(), F.concat(F.lit("UNKNOWN_KEY:"), F.coalesce("key", F.lit("")))).when(~F.coalesce(c("operator") == allowed, F.lit(False)), F.concat(F.lit("INVALID_OPERATOR:"), "key"))
    rows = criteria.withColumn("error", error)
    at = lambda cond, value: F.transform(F.array_sort(F.collect_list(F.when(cond & c("error").isNull(), F.struct("pos", value.alias("v"))))), lambda s: s["v"])
    last = lambda key, value: F.max_by(F.when(c("key") == key, value), F.when((c("key") == key) & c("error").isNull(), c("pos")))
    plain = c("key").isin("funding", "hiring", "technology", "revenue", "website")
    told = F.concat(c("operator"), F.lit(": "), F.when(F.size("terms") > 0, F.array_join("terms", ", ")).when(c("low").isNotNull() | c("high").isNotNull(), F.concat_ws("-", "low", "high")).otherwise(F.coalesce("text", F.lit(""))))
    labelled = lambda name, text: F.struct(F.coalesce("label", name).alias("label"), text.alias("description"))
    made = rows.groupBy("icp_id").agg(
        F.array_sort(F.collect_list("error")).alias("errors"), *[F.flatten(at(c("key") == k, F.coalesce("terms", none))).alias(k) for k in LISTS],
        F.coalesce(last("exclusions", F.coalesce("terms", none)), none).alias("exclusions"), last("employee_range", c("low")).alias("min_employees"), last("employee_range", c("high")).alias("max_employees"),
        at(c("key") == "custom", labelled(F.lit("Custom requirement"), F.coalesce("text", F.lit("")))).alias("custom_rules"), at(plain, labelled(label, told)).alias("other_preferences"),
    )
    fine = F.size("errors") == 0
    return made.select("icp_id", "errors", *[F.when(fine, c(x)).alias(x) for x in made.columns if x not in ("icp_id", "errors")])


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("low", pa.int64()), ("high", pa.int64())])
SPANS = "array<struct<start: int, end: int, kind: string, value: string, low: long, high: long>>"
#: A number begins where no digit stands before it, or where its groups of thousands may: long runs of digits are begun once.
BEGIN = r"(?:(?<!\d)|(?=\d{1,3},))"


class Scanner:
    """Finds, by position, what a text asks for."""

    def __init__(self, keys: Collection[str]) -> None:
        made = lambda pattern: re.compile(pattern, re.I | re.A)
        self.keys = set(keys)
        self.terms = [(k, made(p), label) for k, terms in TERMS.items() if k in self.keys for p, label in terms.items()]
        self.labels = {label.lower(): label for terms in TERMS.values() for label in terms.values()}
        self.trigger, self.clause_end, self.employees = made(TRIGGER), made(CLAUSE_END), made(BEGIN + EMPLOYEES)
        self.revenue = (made(rf"(?:(?=\$)|{BEGIN}){REVENUE[0]}"), made(REVENUE[1]))
        self.item, self.word, self.requirement = made(r",|\band\b|\bor\b"), re.compile(r"\b\w", re.A), re.compile(REQUIREMENT, re.A)
        self.sentence, self.fragment = re.compile(r"(?<=[.!?])\s+"), made(r"[.,;]|\band\b")
        self.lead = made(r"(?:and|or)\s+")

    def clauses(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end of the trigger, end) of each clause that excludes; one may stand in another."""
        ends = [m.start() for m in self.clause_end.finditer(text)]
        out = []
        for m in self.trigger.finditer(text):
            k = bisect_left(ends, m.end())
            out.append((m.start(), m.end(), ends[k] if k < len(ends) else len(text)))
        return out

    def parts(self, text: str, begin: int, end: int, separator: re.Pattern) -> Iterator[tuple[int, int]]:
        """Where the pieces of a stretch stand, without the blanks around them."""
        at = begin
        for m in [*separator.finditer(text, begin, end), None]:
            piece = text[at : m.start() if m else end]
            start = at + len(piece) - len(piece.lstrip())
            yield start, start + len(piece.strip())
            at = m.end() if m else end

    def items(self, text: str, clauses: list[tuple[int, int, int]]) -> Iterator[tuple]:
        for _, begin, end in clauses:
            for a, b in self.parts(text, begin, end, self.item):
                m = self.lead.match(text, a, b)
                a = m.end() if m else a
                if b - a > 1:
                    own = text[a:b]
                    yield a, b, "exclusions", self.labels.get(own.lower()) or self.word.sub(lambda w: w[0].upper(), own), None, None

    def ranges(self, text: str) -> Iterator[tuple]:
        """The first range of employees, and the first of revenue in the first wording that occurs."""
        number = lambda digits, unit=None: int(digits.replace(",", "")[:30]) * UNITS.get((unit or "").lower(), 1)
        held = lambda n: n if n < 1 << 63 else None
        low = text.lower()
        m = self.employees.search(text) if "employee_range" in self.keys and "employees" in low else None
        if m:
            yield m.start(), m.end(), "employee_range", m[0], held(number(m[1])), held(number(m[2]))
        found = (p.search(text) for p in self.revenue) if "revenue" in self.keys and "revenue" in low else ()
        m = next((m for m in found if m), None)
        if m:
            yield m.start(), m.end(), "revenue", m[0], held(number(m[1], m[2])), held(number(m[3], m[4]))

    def __call__(self, text: str) -> list[tuple]:
        clauses = self.clauses(text)
        inside = lambda at: any(a <= at < b for a, _, b in clauses)
        out, claimed = [], []
        for key, group in groupby(self.terms, key=lambda t: t[0]):
            own = []
            for _, pattern, label in group:
                # Of each term the first mention outside every clause.
                m = next((m for m in pattern.finditer(text) if not inside(m.start())), None)
                if m:
                    own.append((m.start(), m.end(), key, label, None, None))
            out += own
            if own:
                claimed.append(", ".join(text[a:b] for a, b, *_ in own))
        excluded = list(self.items(text, clauses)) if "exclusions" in self.keys else []
        found = list(self.ranges(text))
        claimed += [s[3] for s in found]
        return out + excluded + found + list(self.leftovers(text, clauses if excluded else [], claimed))

    def leftovers(self, text: str, clauses: list[tuple[int, int, int]], claimed: list[str]) -> Iterator[tuple]:
        """Sentences that nothing was found in, and fragments of what else is left.

        Claimed wordings go where they first stand; the terms of one key count as
        one wording, joined by commas.
        """
        left, place = list(text), list(range(len(text)))
        for a, _, b in clauses:
            left[a:b] = " " * (b - a)
        rest = "".join(left)

        def drop(a: int, b: int) -> None:
            nonlocal rest
            rest = rest[:a] + " " + rest[b:]
            place[a:b] = [place[a]] if a < len(place) else []

        for wording in claimed:
            m = re.search(re.escape(wording), rest, re.I)
            if m:
                drop(*m.span())
        if "custom" in self.keys:
            pieces = self.sentence.split(rest)
            bare = lambda s: len("".join(s.split()))
            at = 0
            for piece, m in zip(pieces, [*self.sentence.finditer(text), None][: len(pieces)], strict=False):
                own = text[at : m.start() if m else len(text)]
                if self.requirement.search(piece.strip()) and bare(piece) >= bare(own) * 0.8:
                    begin = at + len(own) - len(own.lstrip())
                    yield begin, begin + len(own.strip()), "custom", own.strip(), None, None
                    k = rest.find(piece)
                    drop(k, k + len(piece))
                at = m.end() if m else len(text)
        for a, b in self.parts(rest, 0, len(rest), self.fragment):
            if b - a > 3 and rest[a:b].lower() not in FILLERS:
                yield place[a], place[b - 1] + 1, "unmatched", rest[a:b], None, None


def spans(text: Column, keys: Collection[str] = tuple(CATALOG)) -> Column:
    """What a free text asks for, as array<struct<start, end, kind, value, low, high>>; places are code points, ends exclusive.

    Kinds are the filters among ``keys``: terms with their labels, each where
    it first stands outside every clause that excludes (a clause may stand in
    another); the items of such clauses; ranges with their bounds (null: too
    large for a long); ``custom``, a whole sentence that nothing was found in;
    and ``unmatched``, what else is left. Null text asks for nothing.
    """
    names = sorted(keys)

    @F.arrow_udf(SPANS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(names)
        fields = SPAN.names
        for texts in batches:
            yield pa.array([[dict(zip(fields, s, strict=True)) for s in scanner(t)] if t is not None else [] for t in texts.to_pylist()], pa.list_(SPAN))

    return scan(text)


def extracted(rows: DataFrame, text: str, keys: Collection[str] = tuple(CATALOG)) -> DataFrame:
    """``rows`` with spans and what follows from them: a list for each of TERMS, exclusions, min_ and max_employees, min_ and max_revenue, requirements, unmatched."""
    found = rows.withColumn("spans", spans(F.col(text), keys))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    values = lambda kind: F.transform(of(kind), lambda s: s["value"])
    bound = lambda kind, side: F.get(of(kind), F.lit(0))[side]
    return found.select(
        "*", *[F.array_distinct(values(k)).alias(k) for k in (*TERMS, "exclusions")], bound("employee_range", "low").alias("min_employees"), bound("employee_range", "high").alias("max_employees"),
        bound("revenue", "low").alias("min_revenue"), bound("revenue", "high").alias("max_revenue"), values("custom").alias("requirements"), values("unmatched").alias("unmatched"),
    )


def _new_terms(own: Column, proposed: Column) -> Column:
    """Proposed terms that are not there yet, whatever their case, each once."""
    lows = F.transform(own, F.lower)
    fold = F.aggregate(proposed, F.array().cast("array<string>"), lambda kept, t: F.when(F.array_contains(lows, F.lower(t)) | F.exists(kept, lambda k: F.lower(k) == F.lower(t)), kept).otherwise(F.array_append(kept, t)))
    return fold


def merge_terms(own: Column, proposed: Column) -> Column:
    """A user's terms first, as they are, then proposed ones that are new."""
    return F.concat(own, _new_terms(own, proposed))


def merge_strategy(icps: DataFrame) -> DataFrame:
    """Profiles with a model's proposals merged in.

    Takes industries, company_types, excluded, combinations and, as proposed,
    industry_terms, combination_terms, company_type_terms, exclusion_terms
    (arrays, null: empty). Proposed combinations count as such only if the
    user did not name them.
    """
    none = F.array().cast("array<string>")
    g = lambda n: F.coalesce(n, none)
    lows = F.transform(g("industries"), F.lower)
    fresh = F.filter(g("combination_terms"), lambda t: ~F.array_contains(lows, F.lower(t)))
    # New names first: inside a lambda a column's name would mean its new value.
    made = icps.withColumns({
        "__industries": merge_terms(g("industries"), F.concat(g("industry_terms"), g("combination_terms"))), "__combinations": merge_terms(g("combinations"), fresh),
        "__company_types": merge_terms(g("company_types"), g("company_type_terms")), "__excluded": merge_terms(g("excluded"), g("exclusion_terms")),
    })
    names = ("industries", "combinations", "company_types", "excluded")
    kept = [x for x in icps.columns if x not in (*names, "industry_terms", "combination_terms", "company_type_terms", "exclusion_terms")]
    return made.select(*kept, *[F.col(f"__{n}").alias(n) for n in names])
