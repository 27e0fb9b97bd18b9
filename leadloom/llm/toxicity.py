"""Toxicity: a convolutional text classifier in numpy.

A word is the sum of the hashed embeddings of itself and of its first four,
five and six letters, so that inflected forms share a vector. Filters of
widths 1, 2 and 3 run over a whole text, each keeps its greatest response, and
a logistic layer turns those into a score. Thresholds are calibrated for each
language on labelled rows that the training did not see.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, cut, id_and_text, joined, text_slices

#: The model's shape; the labelled rows, and bytes of their texts, that it may be fitted on at most; texts in which a feature must occur.
WIDTHS, FILTERS, DIM = (1, 2, 3), 8, 12
TRAIN_ROWS, TRAIN_BYTES, MIN_TEXTS, EPOCHS, BATCH = 4000, 100_000_000, 4, 6, 32
#: A threshold that no score reaches: without both labels nothing is known, and nothing is rejected.
NEVER = 2.0
PREFIXES = (4, 5, 6)
PUNCTUATION = b".,!?;:\"'()[]{}<>*#$%&-"
PAD = max(WIDTHS)


def features(word: bytes) -> tuple[int, ...]:
    """Hashes of a lower-cased word and its prefixes."""
    core = word.strip(PUNCTUATION)
    if not core:
        return ()
    text = core.decode("utf-8", "replace")
    return (zlib.crc32(b"=" + core), *(zlib.crc32(b"%d" % n + text[:n].encode()) for n in PREFIXES if len(text) >= n))


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    table: np.ndarray  # their embeddings; one more row, of zeros, for all others
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    shift: float
    trained: bool = True
    thresholds: dict[str, float] = field(default_factory=dict)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, len(self.keys))

    def responses(self, vectors: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(place, filter): each place of texts that begin at ``starts`` and end with PAD empty words."""
        made = np.empty((len(vectors), len(WIDTHS) * FILTERS), np.float32)
        for k, w in enumerate(WIDTHS):
            own = made[:, k * FILTERS : (k + 1) * FILTERS]
            own[:] = vectors @ self.filters[k][0]
            for j in range(1, w):
                own[:-j] += vectors[j:] @ self.filters[k][j]
        ends = np.r_[starts[1:], len(vectors)]
        for j in range(1, PAD):  # of the padding only the first place counts: no filter there sees the next text
            made[ends - j] = -np.inf
        return made + self.bias

    def score(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.maximum(best, 0) @ self.out + self.shift, -30, 30)))


class Scorer:
    """Scores texts; remembers the vectors of words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.vectors, self.used = np.zeros((1024, DIM), np.float32), 0

    def places(self, text: str) -> list[int]:
        """Rows of the words in ``self.vectors``; row 0 is zero."""
        words, get = text.lower().encode("utf-8", "replace").split(), self.known.get
        found = list(map(get, words))
        if None in found:
            new = list({w for w, k in zip(words, found, strict=True) if k is None})
            own = [features(w) for w in new]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            rows = self.model.rows(np.array([x for f in own for x in f], np.int64))
            total = np.zeros((len(new), DIM), np.float32)
            np.add.at(total, np.repeat(np.arange(len(new)), sizes), self.model.table[rows])
            live = np.flatnonzero(total.any(axis=1))
            first = 1 + self.used
            while first + len(live) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            self.vectors[first : first + len(live)] = total[live]
            self.used += len(live)
            at = np.zeros(len(new), np.int64)
            at[live] = first + np.arange(len(live))
            self.known.update(zip(new, at.tolist(), strict=True))
            found = list(map(self.known.__getitem__, words))
        return found

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.forget()
        flat, starts = [], []
        for t in texts:
            starts.append(len(flat))
            flat += self.places(t)
            flat += [0] * PAD
        starts = np.array(starts, np.int64)
        best = np.maximum.reduceat(self.model.responses(self.vectors[np.array(flat, np.int64)], starts), starts, axis=0)
        return self.model.score(best)


def fit(texts: list[str], labels: np.ndarray, seed: int = 7, warm: bool = True) -> Model:
    """Train on whole texts.

    Without both labels the model is not trained: it gives every text the
    share of toxic ones, one of each label added, or 0.25 without any label.
    """
    rnd = np.random.default_rng(seed)
    words = [t.lower().encode("utf-8", "replace").split() for t in texts]
    seen = {w: features(w) for w in set().union(*words)}
    words = [[seen[w] for w in ws] for ws in words]
    n_pos, n = int(labels.sum()), len(labels)
    filters = [rnd.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    if not n_pos or n_pos == n:
        nothing, share = np.zeros(len(WIDTHS) * FILTERS, np.float32), (n_pos + 1) / (n + 2) if n else 0.25
        return Model(np.zeros(0, np.int64), np.zeros((1, DIM), np.float32), filters, nothing, nothing, float(np.log(share / (1 - share))), trained=False)
    own = [np.unique(np.array([x for f in ws for x in f], np.int64)) for ws in words]
    keys, at = np.unique(np.concatenate(own), return_inverse=True)
    texts_with = np.bincount(at, minlength=len(keys))
    toxic_with = np.bincount(at, weights=np.repeat(labels, list(map(len, own))), minlength=len(keys))
    often = texts_with >= MIN_TEXTS
    keys, texts_with, toxic_with = keys[often], texts_with[often], toxic_with[often]
    # Warm start: the first dimension is the feature's shrunk log-odds, which the first filter of each width reads.
    share, weight = n_pos / n, 10.0
    odds = np.log((toxic_with + weight * share) / (texts_with - toxic_with + weight * (1 - share)) / (share / (1 - share)))
    table = rnd.normal(0, 0.02, (len(keys) + 1, DIM)).astype(np.float32)
    if warm:
        table[:-1, 0] = np.maximum(odds, 0) / 2
        for f in filters:
            f[:, 0, 0] = 1.0
    table[-1] = 0
    width = len(WIDTHS) * FILTERS
    model = Model(keys, table, filters, np.full(width, -0.1, np.float32), rnd.normal(0, 0.1, width).astype(np.float32), float(np.log(share / (1 - share))))
    if warm:
        model.out[::FILTERS] = 1.0

    # Every word as up to four rows of the table, filled up with the zero row; PAD empty words end a text.
    zero, most = len(keys), 1 + len(PREFIXES)
    rows = []
    for ws in words:
        grid = np.full((len(ws) + PAD, most), -1, np.int64)
        for k, f in enumerate(ws):
            grid[k, : len(f)] = f
        hit = model.rows(grid.ravel()).reshape(grid.shape)
        rows.append(np.where(grid < 0, zero, hit).astype(np.int32))
    sums = {"table": np.zeros(len(table), np.float32) + 1e-2, "filters": [np.zeros_like(f) + 1e-2 for f in filters], "bias": np.zeros(width) + 1e-2, "out": np.zeros(width) + 1e-2, "shift": 1e-2}
    rate = 0.1
    for _ in range(EPOCHS):
        order = rnd.permutation(n)
        for b in range(0, n, BATCH):
            who = order[b : b + BATCH]
            grid = np.concatenate([rows[k] for k in who])
            starts = np.r_[0, np.cumsum([len(rows[k]) for k in who])[:-1]]
            vectors = model.table[grid].sum(axis=1)
            made = model.responses(vectors, starts)
            best = np.maximum.reduceat(made, starts, axis=0)
            error = (model.score(best) - labels[who]) / len(who)
            active = best > 0
            grad_best = error[:, None] * model.out * active
            grad_out = (error[:, None] * np.maximum(best, 0)).sum(axis=0) + 1e-4 * model.out
            lengths = np.diff(np.r_[starts, len(grid)])
            text, unit = np.nonzero(active)
            place, filled = np.nonzero(made == np.repeat(best, lengths, axis=0))
            first = np.zeros((len(who), width), np.int64)
            first[np.repeat(np.arange(len(who)), lengths)[place][::-1], filled[::-1]] = place[::-1]  # of equal ones the first is written last
            spots = first[text, unit]
            g = grad_best[text, unit]
            grad_rows, grad_values, grad_filters = [], [], [np.zeros_like(f) for f in filters]
            for k, w in enumerate(WIDTHS):
                mine = unit // FILTERS == k
                u = unit[mine] % FILTERS
                for j in range(w):
                    at = spots[mine] + j
                    np.add.at(grad_filters[k][j].T, u, g[mine][:, None] * vectors[at])
                    push = g[mine][:, None] * model.filters[k][j][:, u].T
                    grad_rows.append(grid[at].ravel())
                    grad_values.append(np.repeat(push, most, axis=0))
            touched, inverse = np.unique(np.concatenate(grad_rows), return_inverse=True)
            total = np.zeros((len(touched), DIM), np.float32)
            np.add.at(total, inverse, np.concatenate(grad_values))
            real = touched != zero
            touched, total = touched[real], total[real]
            sums["table"][touched] += (total**2).sum(axis=1)
            model.table[touched] -= rate * total / np.sqrt(sums["table"][touched])[:, None]
            for k, gf in enumerate(grad_filters):
                sums["filters"][k] += gf**2
                model.filters[k] -= rate * gf / np.sqrt(sums["filters"][k])
            for name, grad in (("bias", grad_best.sum(axis=0)), ("out", grad_out), ("shift", error.sum())):
                sums[name] = sums[name] + grad**2
                setattr(model, name, getattr(model, name) - rate * grad / np.sqrt(sums[name]))
            model.bias, model.out, model.shift = model.bias.astype(np.float32), model.out.astype(np.float32), float(model.shift)
    return model


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list[str | None]) -> dict[str, float]:
    """For each language the threshold of best F1, shrunk toward the one of all languages ("")."""

    def best(s: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-s, kind="stable")
        hit, cut = np.cumsum(y[order]), s[order]
        f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
        f1[:-1][cut[:-1] == cut[1:]] = -1
        k = int(f1.argmax())
        below = cut[k + 1] if k + 1 < len(cut) else 0.0
        return float((cut[k] + below) / 2)

    made = {"": best(scores, labels)} if labels.any() else {"": 0.5}
    langs = np.array([x or "" for x in langs])
    for lang in set(langs.tolist()) - {""}:
        own = langs == lang
        n = labels[own].sum()
        if n:
            made[lang] = float((n * best(scores[own], labels[own]) + 10 * made[""]) / (n + 10))
    return made


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", held_out: int = 5) -> Model:
    """Fit on at most TRAIN_ROWS labelled documents of TRAIN_BYTES together, chosen by a hash of their ids.

    Documents whose crc32(id as text) mod ``held_out`` is 0 are never used;
    remainder 1 calibrates the thresholds, the rest trains. An id that repeats
    gives its least text; a text that would pass the bound in bytes is left
    out. A table without languages has one threshold.
    """
    part = F.pmod(F.crc32(F.col("i").cast("string").cast("binary")), F.lit(held_out))
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y"))
        .where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y")).withColumn("part", part)
        .where("part <> 0").orderBy(F.xxhash64("i"), "i").limit(TRAIN_ROWS)
    )
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.struct(F.coalesce(F.col(text_col), F.lit("")).alias("t"), lang.alias("l")).alias("v"))
    sample = texts.join(F.broadcast(chosen), "i").groupBy("i").agg(F.min("v").alias("v"), F.first("y").alias("y"), F.first("part").alias("part"))
    sample = cut(sample.select("i", "v.t", "v.l", "y", "part"), "sample")
    taken, total = [], 0
    for r in sample.select("i", F.octet_length("t").alias("n")).orderBy(F.xxhash64("i"), "i").collect():
        if total + r.n <= TRAIN_BYTES:
            taken.append(r.i)
            total += r.n
    sample = sorted(map(tuple, sample.where(F.col("i").isin(taken)).collect()), key=lambda r: r[0]) if taken else []
    fitting, rest = [r for r in sample if r[4] != 1], [r for r in sample if r[4] == 1]
    model = fit([r[1] for r in fitting], np.array([r[3] for r in fitting], np.float64))
    judged = rest or fitting
    if judged and model.trained:
        scorer = Scorer(model)
        scores = np.concatenate([scorer([r[1] for r in judged[k : k + 200]]) for k in range(0, len(judged), 200)])
        model.thresholds = calibrate(scores, np.array([r[3] for r in judged], np.float64), [r[2] for r in judged])
    else:
        model.thresholds = {"": NEVER}
    return model


def score_column(docs: DataFrame, model: Model, text_col: str = "text"):
    """A column with the score of each whole text; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield joined([pa.array(scorer(part).astype(np.float64)) for _, part in text_slices(texts, 600_000)], pa.float64())

    return run(F.coalesce(F.col(text_col), F.lit("")))


def threshold_column(model: Model, lang_col: str = "lang"):
    """The calibrated threshold of a row's language; unknown or null languages take the common one."""
    out = F.lit(model.thresholds.get("", 0.5))
    for lang, t in sorted(model.thresholds.items()):
        if lang and lang_col:
            out = F.when(F.col(lang_col) == lang, F.lit(t)).otherwise(out)
    return out


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 5) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Only texts enter a score. Null and empty texts get the score of a text
    without words. A null id is not held out. Without both labels every text
    has one score, below 0.5 unless all labels are toxic. Repeated rows are scored each; repeated labels of a document
    count as toxic if one is; an empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col, held_out=held_out)
    rows = id_and_text(docs, id_col, text_col)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(held_out)) == 0, F.lit(False))
    return rows.withColumn("score", score_column(rows, model)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below their language's threshold; all of them without both labels."""
    model = train(docs, labels, id_col, text_col, lang_col)
    return docs.where(score_column(docs, model, text_col) < threshold_column(model, lang_col if lang_col in docs.columns else "")).select(*[F.col(f"`{c}`") for c in docs.columns])
