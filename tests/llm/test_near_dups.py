import random
import re

import numpy as np
import xxhash
from leadloom.llm.near_dups import links, simhash_components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    out = []
    for k, (i, p) in enumerate(prints):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        out.append((i, f"{p:016x}", min(ids, default=None)))
    return out


def make(n, seed):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice(["alpha", "Beta", "gamma", "déjà", "ÉTÉ", "x", "y"]) for _ in range(rnd.choice([1, 2, 3, 80, 300]))) for _ in range(n // 4)]
    rows = [(k, rnd.choice(base) + rnd.choice(["", " tail", "\n", " x y"])) for k in range(n)]
    return rows + [(1000, None), (1001, ""), (None, ""), (None, base[0]), (5, rows[5][1])]


def test_components_match_plain_search(spark):
    rows = make(80, 3)
    got = simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_components(rows)))


def test_empty_table_and_clashing_columns(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(1, "a b c d", "z", 7)], "doc_id long, text string, fp string, component long")
    assert simhash_components(df).count() == 1


def test_tree_search_finds_every_link():
    rnd = np.random.default_rng(1)
    for _ in range(20):
        centre = rnd.integers(0, 1 << 63, dtype=np.uint64)
        flips = rnd.integers(0, 64, (300, 6)).astype(np.uint64)
        prints = centre ^ np.bitwise_xor.reduce(np.uint64(1) << flips[:, : rnd.integers(1, 7)], axis=1)
        shard = np.sort(rnd.integers(0, 5, 300))
        label = links(prints, shard)
        want = np.arange(300)
        near = (np.bitwise_count(prints[:, None] ^ prints) <= 2) & (shard[:, None] == shard)
        while True:
            new = np.array([want[near[k]].min() for k in range(300)])
            if (new == want).all():
                break
            want = new
        assert (label == want).all()
