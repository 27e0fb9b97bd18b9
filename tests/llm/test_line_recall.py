"""How much of a planted passage goes: README gives the figures."""

import random

from leadloom.llm.line_dedup import line_dedup, without_repeats


def planted(lengths, each):
    """Documents of ten lines of their own around a passage; every passage stands in two of them."""
    rnd = random.Random(11)
    line = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(6))
    rows, about = [], {}
    for n in lengths:
        for _ in range(each):
            passage = [line() for _ in range(n)]
            for _ in range(2):
                before, after = [line() for _ in range(rnd.randrange(3, 8))], [line() for _ in range(5)]
                about[len(rows)] = (n, set(passage), len(rows) % 2)
                rows.append((len(rows), "\n".join([*before, *passage, *after])))
    return rows, about


def share_removed(got, about):
    gone, whole = {}, {}
    for doc_id, text in got:
        n, passage, later = about[doc_id]
        if later:
            left = set(text.split("\n"))
            gone[n] = gone.get(n, 0) + sum(x not in left for x in passage)
            whole[n] = whole.get(n, 0) + n
    return {n: gone[n] / whole[n] for n in whole}


def test_what_goes_of_planted_passages(spark):
    lengths = (2, 3, 4, 8, 30)
    rows, about = planted(lengths, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chunks = share_removed([(r.doc_id, r.text) for r in line_dedup(docs).select("doc_id", "text").collect()], about)
    whole = share_removed([(r.doc_id, r.text) for r in without_repeats(docs).collect()], about)
    print("chunks:", {n: round(x, 2) for n, x in chunks.items()}, "whole runs:", {n: round(x, 2) for n, x in whole.items()})
    # The rule of chunks finds long passages only; whole runs go whole.
    assert all(whole[n] == 1.0 for n in lengths)
    assert chunks[2] < chunks[8] < chunks[30] and chunks[30] > 0.6
