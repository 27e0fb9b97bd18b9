import random
import re
import time

from leadloom.operators import filters as K
from pyspark.sql import functions as F

KEYS = tuple(K.CATALOG)


def by_wording(text):
    """The same by strings alone: what each kind finds, masked away as it is found, without any places."""
    flags = re.I | re.A
    clauses = []
    for m in re.finditer(K.TRIGGER, text, flags):
        rest = text[m.end() :]
        end = re.search(K.CLAUSE_END, rest, flags)
        clauses.append((m.start(), rest[: end.start()] if end else rest, m.end() + (end.start() if end else len(rest))))
    labels = {v.lower(): v for t in K.TERMS.values() for v in t.values()}
    found, claimed = {k: [] for k in (*K.TERMS, "exclusions", "custom")}, []
    for key, terms in K.TERMS.items():
        hits = []
        for p, label in terms.items():
            hits += [(label, m[0]) for m in re.finditer(p, text, flags) if not any(a <= m.start() < b for a, _, b in clauses)][:1]
        found[key] = list(dict.fromkeys(h[0] for h in hits))
        claimed += [", ".join(h[1] for h in hits)] if hits else []
    for _, inner, _ in clauses:
        for item in re.split(r",|\band\b|\bor\b", inner, flags=flags):
            item = re.sub(r"^(?:and|or)\s+", "", item.strip(), flags=flags).strip()
            if len(item) > 1:
                found["exclusions"].append(labels.get(item.lower(), re.sub(r"\b\w", lambda m: m[0].upper(), item, flags=re.A)))
    for p in (K.EMPLOYEES, *K.REVENUE):
        m = re.search(p, text, flags)
        if m and not (p == K.REVENUE[1] and re.search(K.REVENUE[0], text, flags)):
            claimed.append(m[0])
            found["employees" if p == K.EMPLOYEES else "revenue"] = m[0]
    rest = text
    if found["exclusions"]:
        for a, _, b in clauses:
            rest = rest[:a] + " " * (b - a) + rest[b:]
    for c in claimed:
        rest = re.sub(re.escape(c), " ", rest, count=1, flags=re.I)
    cut = lambda s: re.split(r"(?<=[.!?])\s+", s)
    for piece, own in zip(cut(rest), cut(text)):
        if re.search(K.REQUIREMENT, piece.strip(), re.A) and len(re.sub(r"\s", "", piece)) >= len(re.sub(r"\s", "", own)) * 0.8:
            found["custom"].append(own.strip())
            rest = rest.replace(piece, " ", 1)
    parts = [s.strip() for s in re.split(r"[.,;]|\band\b", rest, flags=flags)]
    return found | {"exclusions": list(dict.fromkeys(found["exclusions"])), "unmatched": [s for s in parts if len(s) > 3 and s.lower() not in K.FILLERS]}


def asks(seed, n):
    rnd = random.Random(seed)
    words = [
        "find", "companies", "D2C", "direct to consumer", "in the US", "u.s.", "uk", "Canada", "founder", "co-founder", "series b", "raised funding", "hiring for marketing", "e-commerce shops", "O'Neil", "exclude", "excluding",
        "except for", "not including", "and", "or", "that are", "that have", "with 5", "1,000-5,000 employees", "12345 to 99 employees", "1234,567-9 employees", "revenue of $10M to 2b", "$1.5m - 3 in revenue", "they sell their own consumer products", "for",
        "SaaS", "É", "hospitals that require", "household", "European Union",
    ]
    return ["".join(rnd.choice(words) + rnd.choice([" ", " ", ", ", ". ", "; ", "! ", "\n"]) for _ in range(rnd.randrange(1, 14))) for _ in range(n)]


def test_spans_say_what_wording_says(spark):
    texts = asks(1, 1500)
    rows = K.extracted(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string"), "t").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = by_wording(r.t)
        for key in (*K.TERMS, "exclusions"):
            assert r[key] == want[key], (r.t, key)
        assert r.requirements == want["custom"] and r.unmatched == want["unmatched"], r.t
        for s in r.spans:
            inside = r.t[s.start : s.end]
            assert 0 <= s.start < s.end <= len(r.t)
            if s.kind in ("custom", "employee_range", "revenue"):
                assert inside == s.value
            elif s.kind == "exclusions":
                assert inside.lower() == s.value.lower()
            elif s.kind in K.TERMS:
                assert any(re.fullmatch(p, inside, re.I) for p, v in K.TERMS[s.kind].items() if v == s.value)
        assert [s.value for s in r.spans if s.kind == "employee_range"] == [want[k] for k in ("employees",) if k in want]
        assert [s.value for s in r.spans if s.kind == "revenue"] == [want[k] for k in ("revenue",) if k in want]


def test_nested_triggers_and_word_boundaries(spark):
    row = K.extracted(spark.createDataFrame([("excluding SaaS except for hospitals that are big, e-commerce and O'Neil",)], "t string"), "t").first()
    assert row.exclusions == ["SaaS Except For Hospitals", "Hospitals"] and [(s.start, s.end) for s in row.spans if s.kind == "exclusions"] == [(10, 35), (26, 35)]
    row = K.extracted(spark.createDataFrame([("excluding e-commerce shops, saas and o'neil",)], "t string"), "t").first()
    assert row.exclusions == ["E-Commerce Shops", "SaaS", "O'Neil"] and row.unmatched == []


def test_filters_that_are_not_asked_for_are_left_over(spark):
    df = spark.createDataFrame([("saas firms, excluding banks",)], "t string")
    row = K.extracted(df, "t", ["geography"]).first()
    assert row.industry == [] and row.exclusions == [] and row.unmatched == ["saas firms", "excluding banks"]


def test_long_runs_are_read_once(spark):
    long = ["7" * 400_000 + " employees", "revenue " + "8" * 400_000, "1" + " " * 200_000 + "employees revenue", "exclude " * 3000 + "x", "a" * 500_000]
    began = time.time()
    df = spark.createDataFrame([(t,) for t in long], "t string")
    assert df.select(F.size(K.spans(F.col("t"))).alias("n")).where("n > 0").count() == 5
    assert time.time() - began < 90
