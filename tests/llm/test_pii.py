import random
import re
import time
from itertools import product

import numpy as np
from leadloom.llm import pii
from leadloom.llm.pii import Names, base_spans, field_model, luhn, marginals, personal_spans, viterbi


def plain_base(text):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 14, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (kind == "phone" or luhn(d)):
                out.append((*m.span(), kind))
    return out


def test_base_spans_match_plain_expressions():
    rnd = random.Random(3)
    bits = ["a", "b.c", "@", "@x.org", "d@e", ".", "-", "+", "+1 ", "(555) ", "123", "4567", "255.", "10.0.0.1", "4539 1488 0343 6467", " ", "\n", "é", "_", "%", "0"]
    for _ in range(5000):
        text = "".join(rnd.choices(bits, k=rnd.randrange(12)))
        assert sorted(base_spans(text)) == sorted(plain_base(text)), text


def test_viterbi_matches_every_path():
    rnd = np.random.default_rng(2)
    pairs = rnd.normal(size=(3, 3))
    lengths = [1, 5, 3, 4, 1, 6]
    scores = rnd.normal(size=(sum(lengths), 3))
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    found = viterbi(scores, pairs, starts)
    for s, n in zip(starts, lengths, strict=True):
        value = lambda p: sum(scores[s + t, p[t]] for t in range(n)) + sum(pairs[p[t], p[t + 1]] for t in range(n - 1))  # noqa: B023, E731
        assert tuple(found[s : s + n]) == max(product(range(3), repeat=n), key=value)


def test_names_are_found_where_announced():
    names = Names(field_model())
    texts = ["we met Mr. Peter Kraus today.", "Name: Clara Weiss\nthe end", "The sea is in Spain now. Then it was.", "", "my name is Ruth and so"]
    found = [[t[a:b] for a, b, _ in names.spans(t, l)] for t, l in zip(texts, names.labels(texts), strict=True)]
    assert found == [["Peter Kraus"], ["Clara Weiss"], [], [], ["Ruth"]]


def test_query_shape(spark):
    rows = [(1, "é a@b.org"), (2, None), (2, ""), (None, "x" * 100_000)]
    got = sorted(map(repr, ((r.doc_id, r.n_email, r.spans) for r in personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(map(repr, [(1, 1, "email:2:9"), (2, 0, ""), (2, 0, ""), (None, 0, "")]))


def test_marginals_match_every_path():
    rnd = np.random.default_rng(4)
    pairs, lengths = rnd.normal(size=(3, 3)), np.array([1, 4, 2, 3])
    scores = rnd.normal(size=(4, 4, 3))
    total, here, both = marginals(scores, pairs, lengths)
    for i, n in enumerate(lengths):
        paths = list(product(range(3), repeat=n))
        weight = np.exp([sum(scores[i, t, p[t]] for t in range(n)) + sum(pairs[p[t], p[t + 1]] for t in range(n - 1)) for p in paths])
        assert np.isclose(total[i], np.log(weight.sum()))
        for t in range(4):
            for a in range(3):
                want = sum(w for w, p in zip(weight, paths, strict=True) if t < n and p[t] == a) / weight.sum()
                assert np.isclose(here[i, t, a], want)
                for b in range(3):
                    want = sum(w for w, p in zip(weight, paths, strict=True) if t + 1 < n and (p[t], p[t + 1]) == (a, b)) / weight.sum()
                    assert t + 1 == 4 or np.isclose(both[i, t, a, b], want)


def test_training_gives_the_same_weights():
    longer, other = field_model(), field_model.__wrapped__()
    assert np.array_equal(other.weights, longer.weights) and np.array_equal(other.pairs, longer.pairs)


def held_out():
    """Sentences with names that training never saw, announced in other ways and places than there, and capitals that are none."""
    rnd = random.Random(12)
    first = ["Pedro", "Ingrid", "Wei", "Aoife", "Bruno", "Chloé", "Dmitri", "Esra", "Fatima", "Goran"]
    last = ["Almeida", "Bergström", "Çelik", "Duarte", "Eriksen", "Fontaine", "O'Shea", "Smith-Jones", "Novák", "Papadaki"]
    frames = ["yesterday {} {} spoke to us.", "the letter to {} {} was late", "Then {} {} left, and we stayed.", "it was {} {} again"]
    titles = ["Mr.", "Mrs", "Dr.", "Prof.", "Herr", "Frau"]
    rows = []
    for k in range(400):
        name = f"{rnd.choice(first)} {rnd.choice(last)}" if k % 2 else rnd.choice(last)
        if k % 4 == 3:
            rows.append((f"my name is {name} and I write", [name]))
        else:
            rows.append((rnd.choice(frames).format(rnd.choice(titles), name), [name]))
        rows.append((rnd.choice(["The train to Oslo leaves on Friday.", "From March on the Bank of Spain sells it.", "NEW OFFER from Acme Tea, call now", "it is in the Hague that it was signed"]), []))
    return rows


def test_names_held_out():
    """Precision and recall of names; README gives the figures."""
    names, rows = Names(field_model()), held_out()
    found = [[t[a:b] for a, b, _ in names.spans(t, l)] for (t, _), l in zip(rows, names.labels([t for t, _ in rows]), strict=True)]
    right = sum(len(set(f) & set(want)) for f, (_, want) in zip(found, rows, strict=True))
    precision, recall = right / max(1, sum(map(len, found))), right / sum(len(want) for _, want in rows)
    print("names held out: precision", round(precision, 3), "recall", round(recall, 3))
    assert precision >= 0.9 and recall >= 0.9


def test_long_runs_without_blanks_take_seconds():
    """Runs of five million characters, which no expression may begin anew at each character."""
    began = time.time()
    assert pii.base_spans("7" * 5_000_000) == [] and pii.base_spans("x" * 5_000_000 + "@") == []
    assert [s[2] for s in pii.base_spans("8" * 2_000_000 + ".1.1.1 1.2.3.4")] == ["ip"]
    assert pii.base_spans("+1" + "(" * 2_000_000) == [] and pii.base_spans("1." * 1_000_000)[0][2] == "ip"
    assert time.time() - began < 60


def test_addresses_are_those_of_the_plain_expression():
    rnd, plain = random.Random(8), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(20_000):
        text = "".join(rnd.choices("0012.. a", k=rnd.randrange(24)))
        want = [m.span() for m in plain.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        assert [s[:2] for s in pii.base_spans(text) if s[2] == "ip"] == want
