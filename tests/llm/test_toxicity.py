import random

import numpy as np
from leadloom.llm import toxicity as T


def plain_score(model, text):
    """The forward pass, place by place."""
    words = text.lower().encode("utf-8", "replace").split()
    where = {int(k): n for n, k in enumerate(model.keys.tolist())}
    vectors = [sum((model.table[where[f]] for f in T.features(w) if f in where), np.zeros(T.DIM)) for w in words]
    total = model.shift
    for k, width in enumerate(T.WIDTHS):
        padded = vectors + [np.zeros(T.DIM)] * width
        for u in range(T.FILTERS):
            best = max(sum(float(padded[s + j] @ model.filters[k][j][:, u]) for j in range(width) if s + j < len(padded)) + model.bias[k * T.FILTERS + u] for s in range(len(vectors) + 1))
            total += max(best, 0.0) * model.out[k * T.FILTERS + u]
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def corpus(n, seed=3):
    rnd = random.Random(seed)
    texts = [" ".join(f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(1, 40))) for _ in range(n)]
    labels = [k % 3 == 0 for k in range(n)]
    return [t + (" you vile scum" if y else " kind friend") for t, y in zip(texts, labels, strict=True)], np.array(labels, float)


def test_scores_match_a_plain_forward_pass():
    texts, labels = corpus(200)
    model = T.fit(texts, labels)
    odd = texts[:20] + ["", "scum", "SCUM!", "one two", "é ß İ " * 5, "vile " * 3000]
    got = T.Scorer(model)(odd)
    assert np.allclose(got, [plain_score(model, t) for t in odd], atol=1e-4)
    one = [T.Scorer(model)([t])[0] for t in odd]
    assert np.allclose(got, one, atol=1e-6)


def test_training_follows_the_gradient():
    """The loss falls, with and without a warm start, and a text is judged by its words."""
    texts, labels = corpus(300)
    for warm in (True, False):
        model = T.fit(texts, labels, warm=warm)
        scores = T.Scorer(model)(texts)
        assert ((scores >= 0.5) == labels).mean() > 0.95, warm


def tables(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS predicted", "3 AS held_out", "4 AS i")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_defined_cases(spark):
    texts, labels = corpus(120)
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, None), (None, "scum"), (500, ""), (500, ""), (501, "long " * 300_000), (502, " ")] + [(3, texts[3])] * 5
    marks = [(k, 1, int(y)) for k, y in enumerate(labels)] + [(None, 1, 1), (7, 1, None), (3, None, 1)]
    docs, made = tables(spark, rows, marks)
    got = T.toxicity(docs, made).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in got)
    assert {r.score for r in got if r.doc_id in (500, 502)} == {r.score for r in got if r.doc_id == 500}
    assert T.toxicity(docs.limit(0), made).collect() == []
    kept = T.not_toxic(docs, made)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    odd = docs.selectExpr("*", "1 AS `a.b`", "4 AS `x y`")
    assert T.not_toxic(odd, made).columns == odd.columns and T.not_toxic(odd, made).count() == kept.count()


def test_without_both_labels_nothing_is_rejected(spark):
    rows = [(k, f"plain text {k}") for k in range(50)]
    for marks, predicted in (([], 0), ([(k, 1, 0) for k in range(50)], 0), ([(k, 1, 1) for k in range(50)], 1)):
        docs, made = tables(spark, rows, marks)
        assert T.not_toxic(docs, made).count() == 50
        assert {r.predicted for r in T.toxicity(docs, made).collect()} == {predicted}


def test_the_sample_is_bounded(spark, monkeypatch):
    texts, labels = corpus(60)
    docs, made = tables(spark, [(k, t) for k, t in enumerate(texts)] * 3, [(k, 1, int(y)) for k, y in enumerate(labels)])
    seen = []
    monkeypatch.setattr(T, "fit", lambda texts, labels: seen.append(texts) or T.Model(np.zeros(0, np.int64), np.zeros((1, T.DIM)), [], np.zeros(0), np.zeros(0), 0.0, trained=False))
    T.train(docs, made)
    monkeypatch.setattr(T, "TRAIN_BYTES", 500)
    T.train(docs, made)
    assert len(seen[0]) == len(set(seen[0])) and 0 < sum(map(len, seen[1])) <= 500 < sum(map(len, seen[0]))
