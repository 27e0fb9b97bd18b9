import hashlib
import random
import zlib

import pytest
from leadloom.llm import manifest

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def plain(rows):
    """Whole trees in lists."""
    sources = {}
    for doc_id, text, lang, source, n_chars in rows:
        body = "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars))
        leaf = lambda t, body=body: digest(body, "-" if t is None else f"{len(t.encode())}:{t}")
        small = None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        sources.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf(text), leaf(small if hit else text)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(sources[s])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (some, doc_id, own, now) in enumerate(sorted(sources[s])):
            beside, folded = "", now
            for tree, at in ((trees[s], i), (top, k)):
                for row in tree[:-1]:
                    run, o = row[at // 16 * 16 : at // 16 * 16 + 16], at % 16
                    beside += "".join(run[:o] + run[o + 1 :])
                    folded, at = digest(*run[:o], folded, *run[o + 1 :]), at // 16
            out.append((doc_id if some else None, own, trees[s][-1][0], top[-1][0], digest(beside), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(seed, n, sources):
    rnd = random.Random(seed)
    some = lambda v: None if rnd.random() < 0.05 else v
    rows = [(some(rnd.randrange(10_000)), some("A text É " * rnd.randrange(4)), some("en"), some(rnd.choice(sources)), some(rnd.randrange(9))) for _ in range(n)]
    return rows + rows[:5] + rows[:2]


@pytest.mark.parametrize(("most", "n", "sources"), [(1, 40, ["a", "b"]), (7, 400, ["hot"] * 40 + [f"s{k}" for k in range(40)]), (100, 700, ["Z", "é", ""]), (20_000, 300, ["one"])])
def test_proofs_match_whole_trees(spark, monkeypatch, most, n, sources):
    monkeypatch.setattr(manifest, "RANGE", most)
    rows = rows_of(n, n, sources)
    got = manifest.manifest(spark.createDataFrame(rows, KIND).repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_a_hot_source_is_many_pieces(spark, monkeypatch):
    """Every leaf in one source: no task holds more than RANGE leaves, and each fetches no more nodes than its two edges have."""
    monkeypatch.setattr(manifest, "RANGE", 50)
    held = []
    monkeypatch.setattr(manifest, "proofs", lambda root, run=manifest.proofs: held.append(root) or run(root))
    rows = [(k, f"Text {k}", "en", "all", k) for k in range(900)]
    assert sorted(map(tuple, manifest.manifest(spark.createDataFrame(rows, KIND)).collect()), key=repr) == plain(rows)
    assert len(held) == 1
    for lo, hi in ((0, 899), (100, 149), (511, 513)):
        wanted = manifest.missing(lo, hi, 900)
        assert len(wanted) == len(set(wanted)) <= 30 * manifest.height(900)
        assert not wanted if (lo, hi) == (0, 899) else all(not lo // 16**v <= at <= hi // 16**v for v, at in wanted)


def test_clashing_columns_and_empty_tables(spark):
    rows = rows_of(3, 50, ["x", "y"])
    wide = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS part", "2 AS leaf", "3 AS `a.b`", "4 AS k", "5 AS tree")
    assert sorted(map(tuple, manifest.manifest(wide).collect()), key=repr) == plain(rows)
    assert manifest.manifest(wide.limit(0)).count() == 0


def test_very_long_texts(spark):
    rows = [(k, "Word " * 200_000, None, "s", 1) for k in range(3)]
    assert sorted(map(tuple, manifest.manifest(spark.createDataFrame(rows, KIND)).collect()), key=repr) == plain(rows)
