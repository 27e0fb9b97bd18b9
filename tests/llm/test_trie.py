import hashlib
import random
import zlib

import pytest
from leadloom.llm import tries

KIND = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The trie by lists and dictionaries."""
    conv, whole, members, kids, leaves, saved = {}, {}, {}, {}, {}, {}
    for c, t, r, x in rows:
        if c is not None:
            conv.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for c in conv:
        conv[c] = [x[2:] for x in sorted(conv[c], key=lambda x: x[:2])]
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(conv.get(c - int(abs(c) % 5 * (1 if c > 0 else -1)), [])[:h] + own[h:])
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for n in members:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    for n in sorted(members, key=len, reverse=True):
        own = kids.get(n, [])
        leaves[n] = sum(leaves[x] for x in own) or 1
        saved[n] = sum(saved[x] for x in own) + ((len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0)
    ended = lambda n: ",".join(map(str, sorted(c for c in members[n] if len(whole[c]) == len(n))))
    return sorted(
        [
            (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids.get(n, [])), leaves[n], saved[n], hashlib.sha256(ended(n).encode()).hexdigest())
            for n, m in members.items()
        ],
        key=repr,
    )


def found(spark, rows):
    return sorted(map(tuple, tries.prefix_trie(spark.createDataFrame(rows, KIND)).collect()), key=repr)


def conversations(seed, n, letters, longest):
    """Conversations of few different turns, so that prefixes are shared at every depth."""
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(5 * n), n):
        size = rnd.choice([1, 2, longest, rnd.randrange(1, longest + 1)])
        rows += [(c, t, rnd.choice(["user", None]), rnd.choice(letters)) for t in range(size)]
    return rows


@pytest.mark.parametrize("container", [1, 7, 2000])
def test_the_trie_matches_lists(spark, monkeypatch, container):
    monkeypatch.setattr(tries, "CONTAINER", container)
    rows = conversations(container, 120, ["a", "é", "", None], 12)
    assert found(spark, rows) == plain(rows)


def test_hot_prefixes_copies_and_long_conversations(spark, monkeypatch):
    """A third shares 40 turns, a third are copies, one has 3,000 turns and a copy; large containers burst in few rounds."""
    monkeypatch.setattr(tries, "CONTAINER", 50)
    calls = []
    monkeypatch.setattr(tries, "discard", lambda df: calls.append(1))
    shared = [("user", f"turn {k}") for k in range(40)]
    rows = [(5 * c, t, *x) for c in range(60) for t, x in enumerate([*shared[: 10 + c // 2], ("user", f"own {c}")])]
    rows += [(5 * c, t, "user", f"copy {t}") for c in range(60, 120) for t in range(6)]
    rows += [(5 * c, t, "user", f"long {t}") for c in (900, 901) for t in range(3000)]
    assert found(spark, rows) == plain(rows)
    assert len(calls) <= 12  # 1 + 2 + 4 + ... turns a round


def test_nulls_ties_negative_ids_and_turnless_conversations(spark):
    rows = [(None, 1, "user", "x"), (1, None, None, None), (1, 2, "user", "b"), (-7, 1, "user", "a"), (-5, 1, "user", "c"), (-5, 2, "user", "c"), (10, 1, "a", "same"), (10, 1, "a", "same"), (15, 3, "", "late"), (15, None, "", "early")]
    rows += [(c, 1, "user", "only") for c in range(21, 25)]
    got = found(spark, rows)
    assert got == plain(rows) and any(r[1] == 0 and r[7] != tries.NONE for r in got)


def test_clashing_columns_and_empty_tables(spark):
    rows = conversations(5, 30, ["a", "b"], 4)
    wide = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS pos", "2 AS depth", "3 AS `a.b`", "4 AS top", "5 AS rep", "6 AS ends")
    assert sorted(map(tuple, tries.prefix_trie(wide).collect()), key=repr) == plain(rows)
    assert tries.prefix_trie(wide.limit(0)).count() == 0


def test_the_digest_of_ids_goes_piece_by_piece():
    import pyarrow as pa

    kind = pa.schema([(n, pa.int64()) for n in ("len", "a", "b", "conv")])
    ids = sorted(random.Random(3).sample(range(-500, 500), 60))
    batches = [pa.RecordBatch.from_pylist([{"len": 1, "a": 2, "b": 3, "conv": c} for c in ids[k : k + 7]], kind) for k in range(0, 60, 7)]
    (got,) = [r for b in tries.digests(tries.joined_ids(iter(batches))) for r in b.to_pylist()]
    assert got["ends"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
