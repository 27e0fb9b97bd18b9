"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

A window of a document is compared with an item of its size if it holds
enough shingles of that item; without that, it can't reach SIMILARITY. Items
that may reach it are found by their rarest shingles: of so many of them that a
similar window must hold one. So a shingle that very many items share points
to those only that have hardly another, and each pair of window and item is
known. Of its fingerprint one of eight blocks of eight bits then lies within
RADIUS // 8 bits of the item's, by the pigeonhole principle, if all bits lie
within RADIUS; what is left is verified by weighted-shingle similarity, min
over max of the counts, which slides along with the window. Memory and time are
linear in text and item.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, cut, joined, text_slices, unused

#: Words in a shingle, least similarity, and the most differing bits of a candidate's fingerprint.
SHINGLE_WORDS, SIMILARITY, RADIUS = 5, 0.8, 23
BLOCKS = 8
#: Windows that are fingerprinted at a time; bytes of item texts that one pass over the documents compares.
STARTS, PASS_BYTES = 4096, 16_000_000
EDGES = re.compile(r"^\W+|\W+$")


class Words:
    """Hashes of words, lower-cased and without punctuation at their ends; those of punctuation alone are skipped."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, text: str) -> np.ndarray:
        words, get = text.lower().split(), self.known.get
        found = list(map(get, words))
        if None in found:
            if len(self.known) > CACHE_WORDS:
                self.known = {}
            new = {w: xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) if (x := EDGES.sub("", w)) else 0 for w, h in zip(words, found, strict=True) if h is None}
            self.known.update(new)
            found = [new[w] if h is None else h for w, h in zip(words, found, strict=True)]
        out = np.array(found, np.uint64)
        return out[out != 0]


def shingles(words: np.ndarray, most: int = SHINGLE_WORDS) -> np.ndarray:
    """One hash for each run of ``most`` words; of fewer words, one for all of them."""
    k = min(most, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    total = np.full(n, 1469598103934665603, np.uint64)
    for j in range(k):
        total = (total ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def simhash(hashes: np.ndarray) -> np.uint64:
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0)
    return np.packbits(2 * ones > len(hashes)).view(">u8")[0].astype(np.uint64)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two shingle multisets."""
    shared = sum(min(n, b[x]) for x, n in a.items())
    return shared / (a.total() + b.total() - shared) if shared else 0.0


def spread(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all given ranges (ends inclusive), one range after another."""
    sizes = ends - begins + 1
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def runs_of(starts: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Parts of sorted window starts: windows of n overlap inside a part, which spans no more than STARTS or n places."""
    most = max(STARTS, n)
    for near in np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1):
        yield from np.split(near, np.searchsorted(near, np.arange(near[0] + most, near[-1] + 1, most)))


def window_prints(h: np.ndarray, n: int) -> np.ndarray:
    """The SimHash of every window of n of the shingles ``h``, from running sums of their bits."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64)
    sums = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return np.packbits(2 * (sums[n:] - sums[:-n]) > n, axis=1).view(">u8")[:, 0].astype(np.uint64)


def sliding_similarity(h: np.ndarray, n: int, bag: Counter) -> list[float]:
    """The similarity of every window of n of the shingles ``h`` with an item, one shingle in and one out a step."""
    held, shared, whole, out = Counter(), 0, n + bag.total(), []
    values, need = h.tolist(), dict(bag)
    for k, x in enumerate(values):
        if x in need:
            held[x] += 1
            shared += held[x] <= need[x]
        if k >= n:
            y = values[k - n]
            if y in need:
                shared -= held[y] <= need[y]
                held[y] -= 1
        if k >= n - 1:
            out.append(shared / (whole - shared))
    return out


def within(prints: np.ndarray, item: np.uint64) -> np.ndarray:
    """Which fingerprints lie within RADIUS bits of the item's: those with a block within its share of them, then by all bits."""
    apart = prints ^ item
    blocks = np.bitwise_count(apart.view(np.uint8).reshape(-1, BLOCKS))
    near = np.flatnonzero((blocks <= RADIUS // BLOCKS).any(axis=1))
    return near[blocks[near].sum(axis=1, dtype=np.int64) <= RADIUS]


class Index:
    """Fingerprints and shingles of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], finder: Words) -> None:
        self.ids, self.bags, self.prints, self.own = [], [], [], []
        # Items under SHINGLE_WORDS words are one shingle, which a window of their size equals or doesn't.
        self.short: dict[int, dict[int, int]] = {}
        same: dict[bytes, int] = {}
        for item, text in items:
            words = finder.of(text)
            if not len(words):
                continue
            h = shingles(words)
            if len(words) < SHINGLE_WORDS:
                own = self.short.setdefault(len(words), {})
                own[int(h[0])] = min(item, own.get(int(h[0]), item))
                continue
            # Items of the same shingles are one, which goes by its least id.
            key = np.sort(h).tobytes()
            if key in same:
                self.ids[same[key]] = min(item, self.ids[same[key]])
                continue
            same[key] = len(self.ids)
            self.ids.append(item)
            self.bags.append(Counter(h.tolist()))
            self.prints.append(simhash(h))
            self.own.append(np.unique(h))
        values, of = np.unique(np.concatenate(self.own), return_counts=True) if self.own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keys, holders = [], []
        for k, own in enumerate(self.own):
            bag = self.bags[k]
            # A similar window lacks at most this many of the item's shingles, so it holds one of any more.
            lacks = int(bag.total() - SIMILARITY * bag.total() + 1e-9)
            rare = own[np.argsort(of[np.searchsorted(values, own)], kind="stable")].tolist()
            taken = 0
            for x in rare:
                if taken > lacks:
                    break
                taken += bag[x]
                keys.append(x)
                holders.append(k)
        keys, holders = np.array(keys, np.uint64), np.array(holders, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.held = np.unique(keys), holders[order]
        self.begins = np.r_[np.searchsorted(keys[order], self.keys), len(keys)]

    def windows(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, starts of the windows of its size that hold enough of its shingles)."""
        order = np.argsort(h, kind="stable")
        values = h[order]
        there = np.flatnonzero(np.isin(self.keys, values))
        for k in np.unique(np.concatenate([self.held[self.begins[x] : self.begins[x + 1]] for x in there.tolist()])).tolist() if len(there) else ():
            own, n = self.own[k], self.bags[k].total()
            left, right = np.searchsorted(values, own), np.searchsorted(values, own, side="right")
            some = right > left
            places = np.sort(order[spread(left[some], right[some] - 1)])
            last = max(0, len(h) - n)
            low, high = np.clip(places - n + 1, 0, last), np.minimum(places, last)
            gap = np.flatnonzero(low[1:] > high[:-1] + 1)
            starts = spread(low[np.r_[0, gap + 1]], high[np.r_[gap, len(high) - 1]])
            inside = np.searchsorted(places, starts + n) - np.searchsorted(places, starts)
            starts = starts[inside >= SIMILARITY * n - 1e-9]
            if len(starts):
                yield k, starts

    def best(self, words: np.ndarray) -> tuple[float, int] | None:
        """The highest similarity of any window of a document with any item, and that item; ties: the least id."""
        best: tuple[float, int] | None = None
        for size, own in self.short.items():
            for x in set(shingles(words, size).tolist()) & own.keys() if len(words) >= size else ():
                if best is None or own[x] < best[1]:
                    best = (1.0, own[x])
        h = shingles(words)
        if not len(h) or not len(self.keys):
            return best
        for k, starts in self.windows(h):
            n = self.bags[k].total()
            for own in runs_of(starts, n):
                part = h[own[0] : own[-1] + n]
                n_own = min(n, len(part))  # a document may be shorter than the item
                window = (own - own[0])[within(window_prints(part, n_own)[own - own[0]], self.prints[k])]
                if len(window):
                    scores = sliding_similarity(part, n_own, self.bags[k])
                    top = max(scores[w] for w in window.tolist())
                    if top >= SIMILARITY and (best is None or (-top, self.ids[k]) < (-best[0], best[1])):
                        best = (top, self.ids[k])
        return best


OUT = pa.struct([("similarity", pa.float64()), ("item_id", pa.int64())])


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in parts of about PASS_BYTES, one at a time on the driver; a repeated item comes once."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("t") + 100)).first()[0] or 0
    parts = -(-total // PASS_BYTES)
    for k in range(parts):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).collect()]


def _searcher(shared):
    """The search of one part of the benchmark, which tasks get by broadcast, as a column function."""

    @F.arrow_udf("similarity double, item_id long")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Words()
        index = Index(shared.value, finder)
        for texts in batches:
            done = []
            for _, part in text_slices(texts):
                found = [index.best(finder.of(t)) for t in part]
                done.append(pa.array([f and {"similarity": f[0], "item_id": f[1]} for f in found], OUT))
            yield joined(done, OUT)

    return search


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per input row: doc_id, contaminated, item_id, similarity.

    With ``keep``, all of the input's columns in place of doc_id, and only the
    rows that are not contaminated. A document is contaminated if a window of
    an item's number of words (the whole document, if it is shorter) has a
    similarity of SIMILARITY or more with the item; item_id and similarity
    are those of the most similar item, null if there is none. Words are
    compared lower-cased and without punctuation at their ends. Null and
    empty texts are clean; null items are skipped; repeated rows and null ids
    are answered like others; empty tables are fine on either side.
    """
    sc = docs.sparkSession.sparkContext
    verdict, one_pass = unused(docs, "__contamination"), unused(docs, "__one")
    out = docs.withColumn(verdict, F.lit(None).cast("struct<similarity:double,item_id:bigint>"))
    shared = None
    for items in _items(benchmark, item_col, item_text_col):
        if shared is not None:
            # A benchmark of several parts takes a pass for each, so that one part at a time is held.
            out = cut(out, "passes")
            shared.destroy()
        shared = sc.broadcast(items)
        one = _searcher(shared)(F.coalesce(F.col(text_col), F.lit("")))
        out = out.withColumn(one_pass, one)
        better = F.col(f"{one_pass}.similarity").isNotNull() & (
            F.col(f"{verdict}.similarity").isNull() | (F.col(f"{one_pass}.similarity") > F.col(f"{verdict}.similarity"))
            | ((F.col(f"{one_pass}.similarity") == F.col(f"{verdict}.similarity")) & (F.col(f"{one_pass}.item_id") < F.col(f"{verdict}.item_id")))
        )
        out = out.withColumn(verdict, F.when(better, F.col(one_pass)).otherwise(F.col(verdict))).drop(one_pass)
    bad = F.col(f"{verdict}.similarity").isNotNull()
    if keep:
        return out.where(~bad).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.select(F.col(id_col).alias("doc_id"), bad.alias("contaminated"), F.col(f"{verdict}.item_id").alias("item_id"), F.col(f"{verdict}.similarity").alias("similarity"))
