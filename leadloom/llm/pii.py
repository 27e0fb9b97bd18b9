"""Personal data: expressions for what has a form, a conditional random field for names.

Email, ip, card and phone come from expressions and their checks. Personal
names have no form; a linear-chain conditional random field over word shapes
and a few cue words, trained from a small labelled table that is made by rule,
labels every word of a text, and Viterbi decoding runs over many sentences at
once in numpy.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, id_and_text, joined, text_slices

# The expressions of the base kinds, and all kinds in their order.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")  # a run of digits is begun once; the same matches
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "name")
LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Labels of a word: none, a name's first word, a further word of it.
LABELS = ("O", "B", "I")
CUES = {
    "title": {"mr", "mrs", "ms", "dr", "prof", "herr", "frau", "madame", "monsieur", "señor", "señora"},
    "intro": {"name", "contact", "signed", "author", "attn", "from", "dear", "regards", "sincerely"},
    "is": {"is", "by", "am", "me", "call", "called"},
}
LINK = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four base kinds, leftmost and not overlapping within a kind."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        # What stands before the sign, as far as its letters go, is where the leftmost match begins.
        start = at
        while start > free and text[start - 1] in LOCAL_LETTERS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= len(digits_of(m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return out


def shape(word: str) -> tuple[str, str, str]:
    """(cue, letters, tail) of a word: all that the field knows of it."""
    core = word.strip(".,;:!?()\"'")
    low = core.lower()
    cue = next((k for k, ws in CUES.items() if low in ws), "-")
    if not core:
        letters = "none"
    elif not LINK.fullmatch(core.replace("-", "").replace("'", "") or "1"):
        letters = "digit" if any(c.isdigit() for c in core) else "other"
    elif core.isupper():
        letters = "initial" if len(core) == 1 else "upper"
    elif core[0].isupper() and core[1:].islower():
        letters = "Title"
    else:
        letters = "lower" if core.islower() else "mixed"
    return cue, letters, word[-1] if word and word[-1] in ".,;:!?" else "-"


def labelled_table() -> list[tuple[list[str], list[int]]]:
    """The training sentences, made by rule: names in contexts that announce them, and capitals that are none."""
    first = ["Anna", "John", "María", "Jürgen", "Zoë", "Li"]
    last = ["Smith", "Meyer", "García", "Dupont", "O'Neil", "Kim-Lee"]
    rows: list[tuple[list[str], list[int]]] = []
    for k in range(72):
        a, b = first[k % 6], last[(k // 6 + k) % 6]
        name = [[a, b], [a], [a, "J.", b]][k % 3]
        tags = [1] + [2] * (len(name) - 1)
        start = ["please", "and", "today", "the"][k % 4]
        title = ["Mr.", "Dr.", "Frau", "Mrs", "Herr", "Prof."][k % 6]
        for before, after in (
            ([start, title], ["said", "so."]), (["Name:"], []), (["Contact:"], ["today"]), ([start, "contact", title], [","]),
            (["my", "name", "is"], ["and", "this"]), (["Signed,"], []), (["Dear", title], ["we", "write"]), (["Author:"], ["and", "others."]),
            (["we", "met", title], ["today."]), (["it", "was", "signed", "by", title], ["."]), (["my", "name", "is"], ["."]),
        ):
            rows.append(([*before, *name, *after], [0] * len(before) + tags + [0] * len(after)))
        plain = [["The", "report", "is", "in", "Paris", "now."], ["It", "is", "on", "Monday", "that", "we", "From", "here."], ["SALE!!", "CALL", "NOW!!"],
                 ["token", "=", "4f3a", "Then", "the", "name", "of", "it"], ["From", "the", "start", "at", "The", "sea."], ["Contact", "us", "by", "mail"]]
        for p in plain:
            rows.append((p, [0] * len(p)))
    return rows


def marginals(scores: np.ndarray, pairs: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward sums: the log partition sum of each sentence, and the probabilities of labels and of neighbouring pairs.

    ``scores`` is (sentence, place, label); places from a sentence's length on are padding, with probability 0.
    """
    n, size, k = scores.shape
    inside = np.arange(size) < lengths[:, None]
    alpha, beta = np.zeros((n, size, k)), np.zeros((n, size, k))
    alpha[:, 0] = scores[:, 0]
    for t in range(1, size):
        alpha[:, t] = np.logaddexp.reduce(alpha[:, t - 1, :, None] + pairs, axis=1) + scores[:, t]
    for t in range(size - 2, -1, -1):
        beta[:, t] = np.where(inside[:, t + 1, None], np.logaddexp.reduce(pairs + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2), 0)
    total = np.logaddexp.reduce(alpha[np.arange(n), lengths - 1], axis=1)
    with np.errstate(over="ignore"):
        here = np.where(inside[..., None], np.exp(alpha + beta - total[:, None, None]), 0)
        both = np.where(inside[:, 1:, None, None], np.exp(alpha[:, :-1, :, None] + pairs + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]), 0)
    return total, here, both


class Field:
    """The conditional random field: weights of shapes at three places around a word, and of label pairs."""

    def __init__(self) -> None:
        self.names: dict[tuple[int, str], int] = {}
        self.steps = 100

    def features(self, word: str) -> tuple[str, ...]:
        cue, letters, tail = shape(word)
        return cue, f"{letters}", f"{tail}", f"{cue}/{letters}", f"{letters}{tail}"

    def train(self) -> Field:
        """Maximum likelihood with a small penalty, by Adam over all sentences at once."""
        table = labelled_table()
        size = max(len(w) for w, _ in table)
        for words, _ in table:
            for place in (-1, 0, 1):
                for w in [*words, None]:
                    for f in self.features(w) if w is not None else ("edge",):
                        self.names.setdefault((place, f), len(self.names))
        n, k = len(table), len(LABELS)
        x = np.zeros((n, size, len(self.names)))
        y = np.zeros((n, size), np.int64)
        lengths = np.array([len(w) for w, _ in table])
        for i, (words, tags) in enumerate(table):
            for t in range(len(words)):
                y[i, t] = tags[t]
                for place in (-1, 0, 1):
                    other = words[t + place] if 0 <= t + place < len(words) else None
                    for f in self.features(other) if other is not None else ("edge",):
                        x[i, t, self.names[(place, f)]] = 1
        inside = np.arange(size) < lengths[:, None]
        gold_pairs = np.zeros((k, k))
        np.add.at(gold_pairs, (y[:, :-1][inside[:, 1:]], y[:, 1:][inside[:, 1:]]), 1)
        gold = np.eye(k)[y] * inside[..., None]
        w, pairs = np.zeros((len(self.names), k)), np.zeros((k, k))
        m1, m2 = [np.zeros_like(w), np.zeros_like(pairs)], [np.zeros_like(w), np.zeros_like(pairs)]
        flat = x.reshape(n * size, -1)
        for step in range(1, self.steps + 1):
            scores = (flat @ w).reshape(n, size, k)
            _, here, both = marginals(scores, pairs, lengths)
            grads = [flat.T @ (gold - here).reshape(-1, k) / n - 0.0003 * w, (gold_pairs - both.sum(axis=(0, 1))) / n - 0.0003 * pairs]
            for k2, (p, g) in enumerate(zip((w, pairs), grads, strict=True)):
                m1[k2] = 0.9 * m1[k2] + 0.1 * g
                m2[k2] = 0.99 * m2[k2] + 0.01 * g * g
                p += 0.1 * (m1[k2] / (1 - 0.9**step)) / (np.sqrt(m2[k2] / (1 - 0.99**step)) + 1e-8)
        self.weights, self.pairs = w, pairs
        return self

    def vectors(self, word: str | None) -> np.ndarray:
        """(place, label) scores that a word gives to the next, to itself and to the one before."""
        out = np.zeros((3, len(LABELS)))
        for k, place in enumerate((-1, 0, 1)):
            for f in self.features(word) if word is not None else ("edge",):
                at = self.names.get((place, f))
                if at is not None:
                    out[k] += self.weights[at]
        return out


def viterbi(scores: np.ndarray, pairs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The best labels of many sentences that begin at ``starts`` in one flat array of label scores."""
    lengths = np.diff(np.r_[starts, len(scores)])
    order = np.argsort(-lengths, kind="stable")
    begin, left = starts[order], lengths[order]
    best = scores[begin].copy()
    back = np.zeros((len(scores), scores.shape[1]), np.int8)
    final = np.zeros(len(scores), np.int8)
    longest = int(left[0]) if len(left) else 0
    active = [len(left)]
    for t in range(1, longest):
        n = int(np.searchsorted(-left, -t))  # the first n sentences have more than t words
        active.append(n)
        step = best[:n, :, None] + pairs
        back[begin[:n] + t] = step.argmax(axis=1)
        best[:n] = step.max(axis=1) + scores[begin[:n] + t]
    label = best.argmax(axis=1).astype(np.int8)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        final[at] = label[:n]
        if t:
            label[:n] = back[at, label[:n]]
    return final


class Names:
    """Finds names in texts; remembers the shapes of words."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.known: dict[str, int] = {}
        self.kinds: dict[tuple, int] = {}
        self.table = [self.field.vectors(None)]
        self.ends = [True]

    def kind(self, word: str) -> int:
        """Words of one shape share a row of scores."""
        key = shape(word)
        if key not in self.kinds:
            self.kinds[key] = len(self.table)
            self.table.append(self.field.vectors(word))
            self.ends.append(key[2] in ".!?" and key[0] != "title" and key[1] != "initial")
        return self.kinds[key]

    def labels(self, texts: list[str]) -> list[np.ndarray]:
        """The label of every word of each text; sentences end at line ends and after a word with an end mark."""
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        flat: list[int] = []
        breaks: list[int] = []
        sizes = []
        for t in texts:
            first = len(flat)
            for line in t.split("\n"):
                words = line.split()
                if words:
                    breaks.append(len(flat))
                    found = list(map(self.known.get, words))
                    if None in found:
                        for w in {w for w, k in zip(words, found, strict=True) if k is None}:
                            self.known[w] = self.kind(w)
                        found = list(map(self.known.__getitem__, words))
                    flat += found
            sizes.append(len(flat) - first)
        if not flat:
            return [np.zeros(0, np.int8) for _ in texts]
        kinds, table = np.array(flat), np.array(self.table)
        new = np.zeros(len(kinds), bool)
        new[breaks] = True
        new[1:] |= np.array(self.ends)[kinds[:-1]]
        starts = np.flatnonzero(new)
        before, after = np.r_[0, kinds[:-1]], np.r_[kinds[1:], 0]
        before[new] = 0
        after[:-1][new[1:]] = 0
        found = viterbi(table[before, 0] + table[kinds, 1] + table[after, 2], self.field.pairs, starts)
        return np.split(found, np.cumsum(sizes)[:-1])

    def spans(self, text: str, labels: np.ndarray) -> list[tuple[int, int, str]]:
        """Runs of a first and further words as spans, without punctuation at their ends."""
        if not labels.any():
            return []
        places = []
        at = 0
        for line in text.split("\n"):
            step = at
            for w in line.split():
                step = text.index(w, step)
                places.append((step, w))
                step += len(w)
            at += len(line) + 1
        out, k = [], 0
        while k < len(places):
            if labels[k] == 1:
                last = k
                while last + 1 < len(places) and labels[last + 1] == 2:
                    last += 1
                start = places[k][0] + len(places[k][1]) - len(places[k][1].lstrip("\"'("))
                end = places[last][0] + len(places[last][1].rstrip(".,;:!?\"')"))
                if end > start:
                    out.append((start, end, "name"))
                k = last
            k += 1
        return out


@lru_cache(1)
def field_model() -> Field:
    """The trained field; training always gives the same weights."""
    return Field().train()


OUT = pa.struct([(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("spans", pa.string())])


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, n_name, base_sha256, spans (kind:start:end).

    The four base kinds are as their expressions find them, leftmost and not
    overlapping within a kind, failing ones dropped; names come from the
    random field. base_sha256 covers the base kinds only. Null texts count as
    empty and have no spans; null ids and repeated rows are answered like
    others; an empty table gives an empty result. Nothing shuffles, other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field_model())  # a few hundred weights
    listed = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)

    @F.arrow_udf(", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = Names(shared.value)
        for texts in batches:
            done = []
            for _, part in text_slices(texts):
                every = []
                for text, labels in zip(part, names.labels(part), strict=True):
                    every.append(sorted(base_spans(text) + names.spans(text, labels), key=lambda s: (s[0], KINDS.index(s[2]))))
                base = [[s for s in spans if s[2] != "name"] for spans in every]
                counts = [pa.array([sum(s[2] == k for s in spans) for spans in every], pa.int64()) for k in KINDS]
                digest = pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base], pa.string())
                done.append(pa.StructArray.from_arrays([*counts, digest, pa.array(list(map(listed, every)), pa.string())], fields=list(OUT)))
            yield joined(done, OUT)

    return id_and_text(docs, id_col, text_col).withColumn("r", scan("text")).select("doc_id", "r.*")
