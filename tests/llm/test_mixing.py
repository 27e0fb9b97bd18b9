import random
import re

import pytest
from leadloom.llm import mixing

KIND = "doc_id long, text string, source string"


def targets(sizes):
    """Shares by weight, again and again, until none is above twice its source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, stopped = 1.5 * sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in stopped]
        share = {s: (total - sum(stopped.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        above = [s for s in left if share[s] > 2 * sizes[s]]
        if not above:
            return share | stopped
        stopped |= {s: 2.0 * sizes[s] for s in above}


def some_rows(seed, n, sources):
    rnd = random.Random(seed)
    rows = [(k, "\n".join(["w é"] * int(rnd.paretovariate(1.1) * 3 % 900)), rnd.choice(sources)) for k in range(n)]
    return [*rows, (n, None, "a"), (None, "x y", None), (n + 1, " \t\x0b ", "a"), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2])]


def check(rows, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest, taken = {}, {}, {}
    for _, t, s in rows:
        sizes[s], largest[s] = sizes.get(s, 0) + size(t), max(largest.get(s, 0), size(t))
    want = targets(sizes)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((i is None, i or 0, size(t)) for i, t, _ in rows)
    source_of = {i: s for i, _, s in rows}
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        copies = want[s] / sizes[s] if sizes[s] else 0
        # Every document has the whole part of its copies, and one more at most.
        assert r["taken"] in {r["size"] * int(copies + 1e-9), r["size"] * min(2, int(copies + 1e-9) + 1)}
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= largest[s]


@pytest.mark.parametrize("segment", [4, 1024])
def test_sources_come_near_their_targets(spark, monkeypatch, segment):
    monkeypatch.setattr(mixing, "SEGMENT", segment)
    monkeypatch.setattr(mixing, "FAN", 4)
    rows = some_rows(segment, 900, ["a", "a", "a", "a", "b", "é", "Z", None, "tiny"])
    df = spark.createDataFrame(rows, KIND)
    got = mixing.mixed(df).collect()
    check(rows, got)
    again = mixing.mixed(df.repartition(7).orderBy("text")).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_a_transfer_keeps_the_sum_and_settles_one():
    rnd = random.Random(1)
    for _ in range(2000):
        a, b = rnd.randrange(1, 50), rnd.randrange(1, 50)
        x, y = a * rnd.random(), b * rnd.random()
        p, q = mixing.transfer(a, x, b, y, rnd.random())
        assert p + q == pytest.approx(x + y) and 0 <= p <= a and 0 <= q <= b and (p in (0, a) or q in (0, b))


def test_neither_side_gains_on_average():
    rnd = random.Random(2)
    got = [mixing.transfer(30, 10.0, 50, 20.0, rnd.random())[0] for _ in range(20_000)]
    assert sum(got) / len(got) == pytest.approx(10, abs=0.3)


def test_chances_are_even():
    drawn = sorted(mixing.chance(k * 77, k) for k in range(4000))
    assert all(abs(v - k / 4000) < 0.03 for k, v in enumerate(drawn))


def test_each_document_is_taken_as_often_as_its_share(spark):
    """800 documents of one size, half of them to be taken once more: by hash, not by place."""
    rows = [(k, "a b c", "s") for k in range(800)]
    got = {r["doc_id"]: r["taken"] for r in mixing.mixed(spark.createDataFrame(rows, KIND)).collect()}
    assert sum(got.values()) == 3600 and set(got.values()) == {3, 6}
    assert 150 < sum(got[k] == 6 for k in range(400)) < 250


def test_clashing_columns_and_empty_tables(spark):
    rows = some_rows(4, 60, ["a", "b"])
    df = spark.createDataFrame(rows, KIND)
    wide = df.selectExpr("*", "1 AS sid", "2 AS seg", "3 AS `a.b`", "4 AS h", "5 AS size", "6 AS target")
    assert sorted(map(repr, mixing.mixed(wide).collect())) == sorted(map(repr, mixing.mixed(df).collect()))
    assert mixing.mixed(wide.limit(0)).count() == 0
    none = mixing.mixed(spark.createDataFrame([(1, None, None), (2, "", "a")], KIND)).collect()
    assert {(r["target"], r["taken"]) for r in none} == {(0.0, 0)}


def test_very_long_texts(spark):
    rows = [(1, "word " * 300_000, "s"), (2, "word " * 300_000, "s"), (3, "x", "t")]
    check(rows, mixing.mixed(spark.createDataFrame(rows, KIND)).collect())
