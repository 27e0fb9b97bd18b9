import hashlib
import random

from leadloom.llm import substring
from leadloom.llm.exact import exact_dedup
from leadloom.llm.line_dedup import line_dedup, without_repeats
from leadloom.llm.substring import substring_dedup


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def plain_substring(rows):
    first = {}
    grams = []
    for i, t in rows:
        words = (t or "").encode().split()
        grams.append([tuple(words[k : k + 13]) for k in range(len(words) - 12)])
        for g in grams[-1]:
            first[g] = min(first.get(g, 1 << 63), i)
    out = []
    for (i, t), own in zip(rows, grams, strict=True):
        words = (t or "").encode().split()
        gone = {k + o for k, g in enumerate(own) if first[g] < i for o in range(13)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
        out.append((i, len(words), len(gone), kept))
    return sorted(out)


def passages(seed, n=120, vocabulary=400):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)] + ["é,", "Ü", "x"]
    shared = [" ".join(rnd.choices(words, k=k)) for k in (13, 14, 20, 60, 200)] + ["a " * 40, "a b " * 30]
    rows = []
    for i in range(n):
        parts = [" ".join(rnd.choices(words, k=rnd.choice([0, 1, 5, 12, 40]))) for _ in range(3)]
        parts.insert(rnd.randrange(3), rnd.choice(shared))
        rows.append((rnd.randrange(1000) * 1000 + i, "\n ".join(parts)))
    return rows + [(3, None), (4, ""), (5, rows[0][1]), (5, rows[0][1])]


def test_substring_matches_plain_search(spark):
    rows = passages(1)
    got = sorted(map(tuple, substring_dedup(docs(spark, rows)).select("doc_id", "n_words", "n_removed", "kept").collect()))
    assert got == plain_substring(rows)


def test_substring_takes_crowded_anchors_apart(spark, monkeypatch):
    monkeypatch.setattr(substring, "CROWD", 1)
    rows = passages(2, vocabulary=8)
    got = sorted(map(tuple, substring_dedup(docs(spark, rows)).select("doc_id", "n_words", "n_removed", "kept").collect()))
    assert got == plain_substring(rows)


def test_substring_null_ids_come_last(spark):
    text = " ".join(map(str, range(20)))
    got = {(r.doc_id, r.n_removed) for r in substring_dedup(docs(spark, [(None, text), (7, text)])).collect()}
    assert got == {(None, 20), (7, 0)}
    assert substring_dedup(docs(spark, [])).collect() == []


def test_exact_dedup(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (None, "b"), (None, "b"), (9, "c"), (9, "c"), (5, "x" * 100_000)]
    got = sorted(map(tuple, exact_dedup(docs(spark, rows).selectExpr("*", "1 AS key", "2 AS at")).collect()), key=repr)
    want = [
        (1, 2, 2, False, sha("a")), (2, 2, 2, True, sha("a")), (3, 4, 2, False, sha("")), (4, 4, 2, True, sha("")),
        (None, None, 2, True, sha("b")), (None, None, 2, True, sha("b")), (9, 9, 2, True, sha("c")), (9, 9, 2, True, sha("c")),
        (5, 5, 1, True, sha("x" * 100_000)),
    ]
    assert got == sorted(want, key=repr)
    assert exact_dedup(docs(spark, [])).collect() == []


def test_line_dedup(spark):
    rnd = random.Random(5)
    lines = lambda n: [" ".join(rnd.choices("abcdefghij", k=12)) for _ in range(n)]
    passage = lines(30)
    rows = [(k, "\n".join(lines(8) + passage + lines(8))) for k in range(6)] + [(10, None), (11, ""), (None, "\n".join(passage)), (12, "\n".join(passage * 2))]
    got = {r.doc_id: r for r in line_dedup(docs(spark, rows).selectExpr("*", "'q' AS body", "3 AS key")).collect()}
    assert got[0].n_removed == 0 and got[0].text == rows[0][1]
    assert all(got[k].n_removed >= 15 for k in (1, 2, 3, 4, 5, None)) and got[12].n_removed > 40
    assert (got[10].text, got[10].n_lines, got[11].text) == ("", 1, "")
    assert all(set(got[k].text.split("\n")) >= set(rows[k][1].split("\n")) - set(passage) for k in range(6))
    assert line_dedup(docs(spark, [])).collect() == []


def plain_passages(rows):
    """Lines of repeated runs (two lines and 40 characters, or one line of 50 words) go, all but the first occurrence."""
    def runs(lines):
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                body = "\n".join(lines[a:b])
                if b - a >= 2 and len(body) >= 40 or b - a == 1 and len(body.split()) >= 50:
                    yield a, b, body

    seen, out = set(), {}
    for i, t in sorted(rows):
        lines, gone, own = t.split("\n"), set(), {}
        for a, b, body in runs(lines):
            if body in seen:
                gone |= set(range(a, b))
            elif body in own:
                gone |= set(range(max(a, own[body] + b - a), b))
            own[body] = a
        seen |= set(own)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_repeated_passages_go_whole(spark):
    rnd = random.Random(11)
    line = lambda n: " ".join(f"w{rnd.randrange(9000)}" for _ in range(n))
    passages = {k: [line(60 if k == 1 else 27) for _ in range(k)] for k in range(1, 5)}
    rows = [(i * 10 + k, "\n".join([line(20), line(12), *passage, line(9)])) for k, passage in passages.items() for i in range(12)]
    got = {r.doc_id: r.text.split("\n") for r in without_repeats(docs(spark, rows)).collect()}
    for i, text in rows:
        assert got[i] == [x for x in text.split("\n") if i < 10 or x not in passages[i % 10]]


def test_passages_match_plain_search(spark):
    rnd = random.Random(12)
    pool = ["", "a", "b", "yes no", "x" * 17, "y" * 38, "é" * 20, "m " * 30 + "end", "n " * 60 + "end", "long " * 9]
    rows = [(i, "\n".join(rnd.choices(pool, rnd.choices([1, 6], k=len(pool)), k=rnd.randrange(1, 14)))) for i in range(60)]
    rows += [(100, "\n" * 90), (101, "z\n" * 50), (102, "z\n" * 50 + "q")]
    got = {r.doc_id: r.text for r in without_repeats(docs(spark, rows).repartition(3)).collect()}
    assert got == plain_passages(rows)
    none = {(r.doc_id, r.text) for r in without_repeats(docs(spark, [(None, "x\n" + "y" * 50), (7, None), (8, ""), (9, "x\n" + "y" * 50)])).collect()}
    assert none == {(None, ""), (7, ""), (8, ""), (9, "x\n" + "y" * 50)}
    assert without_repeats(docs(spark, [])).collect() == []
