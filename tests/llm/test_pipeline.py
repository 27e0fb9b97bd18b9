import random
import tracemalloc

import corpus_pipeline
import numpy as np
from leadloom.llm import near_copies
from leadloom.llm.near_copies import near_dedup


def jaccard(a, b):
    def bag(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = bag(a), bag(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def plain_near_dedup(rows):
    label = {k: k for k in range(len(rows))}
    find = lambda k: k if label[k] == k else find(label[k])
    for a in range(len(rows)):
        for b in range(a):
            ta, tb = rows[a][1] or "", rows[b][1] or ""
            if ta == tb or jaccard(ta, tb) >= 0.8:
                label[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), 1 << 63), i)
    return sorted(i for k, (i, _) in enumerate(rows) if least[find(k)] == i)


def make(seed):
    rnd = random.Random(seed)
    base = [" ".join(f"w{rnd.randrange(500)}" for _ in range(n)) for n in (1, 4, 5, 30, 60, 60, 120, 400)]
    rows = []
    for k in range(150):
        words = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 6])):
            words[rnd.randrange(len(words))] = f"v{rnd.randrange(1000)}"
        rows.append((k * 7 % 151, " ".join(words)))
    return rows + [(500, None), (501, ""), (502, " ")]


def test_near_dedup_matches_every_pair(spark, monkeypatch):
    for seed, remembered in ((2000, 100_000), (2, 3)):
        monkeypatch.setattr(near_copies, "REMEMBERED", remembered)
        rows = make(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS `group`")
        got = near_dedup(docs)
        assert got.columns == docs.columns
        assert sorted(r.doc_id for r in got.collect()) == plain_near_dedup(rows)
    assert near_dedup(docs.limit(0)).collect() == []


def pairs_at_the_threshold(n, seed=5):
    """Pairs with a similarity of 0.80 to 0.86, of 15 to 600 words, a third of them with repeated passages; and how similar they are."""
    rnd = random.Random(seed)
    made = []
    while len(made) < n:
        size = int(15 * 40 ** rnd.random())
        a = [f"w{rnd.randrange(100_000)}" for _ in range(size)]
        if len(made) % 3 == 0:
            a += a[: rnd.randrange(6, 14)] * rnd.randrange(1, 6)
        b = list(a)
        for _ in range(max(1, round(len(a) * rnd.uniform(0.02, 0.05)))):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.choice([0, 1, 1])] = [f"v{rnd.randrange(100_000)}"]
        a, b = " ".join(a), " ".join(b)
        if 0.8 <= jaccard(a, b) <= 0.86:
            made.append((a, b))
    return made


def test_pairs_at_the_threshold_are_found(spark):
    """Recall over 4,000 pairs; README gives the figure."""
    pairs = pairs_at_the_threshold(4000)
    docs = spark.createDataFrame([(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string").repartition(4)
    left = {r.doc_id for r in near_dedup(docs).collect()}
    assert set(range(0, 8000, 2)) <= left
    found = 8000 - len(left)
    print("pairs found of 4,000 at 0.80 to 0.86:", found)
    assert found >= 3980


def test_repeated_passages_move_no_fingerprint(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(40):
        words = [f"w{rnd.randrange(9000)}" for _ in range(200)]
        passage = words[:9]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(passage * 100 + words[9:]))]
    got = sorted(r.doc_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain_near_dedup(rows) == list(range(0, 80, 2))


def test_a_family_is_searched_in_bounded_memory(monkeypatch):
    rnd = np.random.default_rng(8)
    base = rnd.choice(1 << 20, 100, replace=False).astype(np.uint64)
    bodies = [np.unique(np.r_[base, np.uint64((1 << 20) + k)]) for k in range(4000)]
    prints = np.uint64(12345) ^ (np.uint64(1) << rnd.integers(0, 64, 4000, dtype=np.uint64))
    want = np.zeros(4000, int)
    tracemalloc.start()
    got = near_copies.verified_links(prints, bodies)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and peak < 120e6


def test_groups_of_a_shard_match_every_pair(monkeypatch):
    monkeypatch.setattr(near_copies, "SEARCHES", 16)
    monkeypatch.setattr(near_copies, "HELD", 1000)
    for seed, hits in ((1, 1), (2, 50), (3, 1_000_000)):
        monkeypatch.setattr(near_copies, "HITS", hits)
        rnd = np.random.default_rng(seed)
        now = [rnd.choice(5000, 40, replace=False) for _ in range(3)]
        held, sets, prints = near_copies.Bodies(), [], []
        for _ in range(200):  # each row is one step further from where its chain began
            k = rnd.choice(3, p=[0.8, 0.1, 0.1])
            now[k] = np.r_[now[k][2:], rnd.integers(0, 1 << 30, 2)] if rnd.random() < 0.3 else now[k]
            sets.append(np.unique(np.r_[now[k], rnd.integers(0, 1 << 30, rnd.integers(0, 8))]).astype(np.uint64))
            prints.append(np.uint64(rnd.integers(0, 1 << 12)))
            held.append(sets[-1].tobytes())
        want = np.arange(200)
        for a in range(200):
            for b in range(a):
                if near_copies.similar(sets[a], sets[b]):
                    want[want == max(want[a], want[b])] = min(want[a], want[b])
        assert len(set(want.tolist())) > 3
        assert (near_copies.verified_links(np.array(prints), held) == want).all()


def test_stages_on_a_small_corpus(spark, tmp_path):
    rnd = random.Random(9)
    prose = lambda n: "\n".join(" ".join(f"w{rnd.randrange(3000)}" for _ in range(12)) for _ in range(n))
    item = prose(4)
    passage = prose(40)
    texts = [prose(6) + (" idiot scum" if k % 4 == 0 else "") for k in range(160)]
    labels = [(k, k % 4 == 0) for k in range(160)]
    leak, copy = prose(3) + "\n" + item + "\n" + prose(3), prose(30)
    texts += [copy, copy, copy.replace("w1 ", "x1 ", 1) + " end", leak, prose(4) + "\n" + passage, prose(4) + "\n" + passage]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(t)) for k, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = docs
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen = stage(spark, seen, str(tmp_path))
        if k < 4:
            assert seen.columns == docs.columns
            kept.append({r.doc_id: r.text for r in seen.collect()})
    clean = {k for k in range(160) if k % 4} | set(range(160, 166))
    assert set(kept[0]) == clean
    assert len(kept[1][165]) < len(texts[165]) / 2 and kept[1][164] == texts[164]
    assert set(kept[2]) >= clean - {161, 162}  # of the copies the line stage has left next to nothing
    assert set(kept[2]) - set(kept[3]) == {163}
    own = corpus_pipeline.near_dedup_stage(spark, docs, str(tmp_path))
    assert {160, 161, 162} & {r.doc_id for r in own.collect()} == {160}
    assert {r.doc_id for r in seen.collect()} == set(kept[3])
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept[3])
