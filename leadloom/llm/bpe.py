"""Byte-level BPE: encoding by batched numpy merge rounds, and decoding.

A text is cut into words by the vocabulary's pattern. The words a task has not
met yet are encoded together: their symbols lie in one flat array, the ranks
of all neighbouring pairs are found by binary search over sorted pair keys,
and each round merges the lowest-ranked pair of every word at once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, id_and_text, joined, text_slices

# The pattern of the public byte-level vocabulary, in full and for ASCII texts.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
NO_RANK = np.iinfo(np.int32).max
#: Distinct words encoded in one flat array.
ROUND_WORDS = 20_000


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def merge_rounds(symbols: np.ndarray, owner: np.ndarray, keys: np.ndarray, made: np.ndarray, ranks: np.ndarray, width: int):
    """Merge until no word has a known pair. ``owner`` ascends; returns (symbols, owner).

    ``keys`` are the sorted pair keys left * width + right, ``ranks`` and
    ``made`` the rank and the symbol of each. Only pairs beside a merge are
    looked up again.
    """

    def look_up(at: np.ndarray) -> None:
        """Ranks and found keys of the pairs that begin at ``at``."""
        pair = symbols[at].astype(keys.dtype) * keys.dtype.type(width) + symbols[at + 1].astype(keys.dtype)
        k = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        known = (keys[k] == pair) & (owner[at] == owner[at + 1])
        rank[at] = np.where(known, ranks[k], NO_RANK)
        found[at] = k

    rank, found = np.full(len(symbols), NO_RANK, np.int32), np.zeros(len(symbols), np.int32)
    if len(symbols) > 1:
        look_up(np.arange(len(symbols) - 1))
    done_s, done_o = [], []
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(owner)]))
        live = least != NO_RANK
        if not live.all():  # finished words leave the array
            done_s.append(symbols[~live])
            done_o.append(owner[~live])
            symbols, owner, rank, found, least = symbols[live], owner[live], rank[live], found[live], least[live]
        if not len(symbols):
            break
        take = np.flatnonzero(rank == least)
        # In a run of overlapping pairs, as in "aaa", every other pair from the left merges.
        run = np.cumsum(np.r_[True, np.diff(take) != 1])
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        take = take[(np.arange(len(take)) - np.repeat(first, np.diff(np.r_[first, len(take)]))) % 2 == 0]
        symbols[take] = made[found[take]]
        keep = np.ones(len(symbols), bool)
        keep[take + 1] = False
        symbols, owner, rank, found = symbols[keep], owner[keep], rank[keep], found[keep]
        place = take - np.arange(len(take))
        rank[place] = NO_RANK
        near = np.concatenate([place, place - 1])
        near = near[(near >= 0) & (near < len(symbols) - 1)]
        if len(near):
            look_up(near)
    symbols, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_s, done_o))
    order = np.argsort(owner, kind="stable")
    return symbols[order], owner[order]


class ByteBpe:
    """A byte-level BPE vocabulary given as the tokenizers library's JSON text."""

    def __init__(self, spec: str):
        made = json.loads(spec)
        vocab, letters = made["model"]["vocab"], byte_letters()
        self.special = {x["content"]: x["id"] for x in made["added_tokens"]}
        self.width = 1 + max(chain(vocab.values(), self.special.values()))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in made["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order].astype(np.uint32 if self.width < 65536 else np.int64), order.astype(np.int32), self.made[order]
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        self.bytes_of = [b""] * self.width
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[x] for x in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.texts_of = [str(i) for i in range(self.width)]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pattern, self.ascii = regex.compile(WORDS), re.compile(ASCII_WORDS, re.A)
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, words: list[str]) -> None:
        """Encode words and remember their ids."""
        for k in range(0, len(words), ROUND_WORDS):
            part = words[k : k + ROUND_WORDS]
            raw = [w.encode("utf-8", "surrogatepass") for w in part]
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            symbols = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
            ids, owner = merge_rounds(symbols, np.repeat(np.arange(len(part)), sizes), self.keys, self.made, self.ranks, self.width)
            ends = np.searchsorted(owner, np.arange(len(part)), side="right").tolist()
            ids, at = ids.tolist(), 0
            for w, end in zip(part, ends, strict=True):
                self.known[w] = tuple(ids[at:end])
                at = end

    def words(self, text: str) -> list[str]:
        return (self.ascii if text.isascii() else self.pattern).findall(text)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        split: list[list] = []
        for t in texts:
            if self.cut and any(x in t for x in self.special):
                parts = self.cut.split(t)
                split.append([self.special[p] if k % 2 else self.words(p) for k, p in enumerate(parts)])
            else:
                split.append([self.words(t)])
        get = self.known.get
        found = [[p if isinstance(p, int) else list(map(get, p)) for p in parts] for parts in split]
        new = {w for parts, got in zip(split, found, strict=True) for p, g in zip(parts, got, strict=True)
               if not isinstance(p, int) and None in g for w, x in zip(p, g, strict=True) if x is None}
        self.learn(list(new))
        out = []
        for parts, got in zip(split, found, strict=True):
            ids: list[int] = []
            for p, g in zip(parts, got, strict=True):
                if isinstance(p, int):
                    ids.append(p)
                else:
                    ids.extend(chain.from_iterable(map(get, p) if None in g else g))
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def vocabulary(path: str) -> ByteBpe:
    """One vocabulary a worker process; the file is part of every machine's installed packages."""
    with open(path, encoding="utf-8") as f:
        return ByteBpe(f.read())


KIND = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
DIGEST = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per input row: doc_id and either (ids, decoded) or their digests.

    ``path`` is the vocabulary's JSON file. Null texts count as empty and have
    no ids; texts of any length are encoded whole; repeated rows and null ids
    are encoded like others; an empty table gives an empty result. Nothing
    shuffles, and other columns are not read.
    """

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(path)
        for texts in batches:
            done = []
            for _, part in text_slices(texts):
                ids = vocab.encode_batch(part)
                if digests:
                    show, raw = vocab.texts_of.__getitem__, vocab.bytes_of.__getitem__
                    sha = lambda b: hashlib.sha256(b).hexdigest()
                    done.append(pa.StructArray.from_arrays([
                        pa.array(list(map(len, ids)), pa.int64()),
                        pa.array([sha(",".join(map(show, x)).encode()) for x in ids], pa.string()),
                        pa.array([sha(b"".join(map(raw, x)).decode("utf-8", "replace").encode()) for x in ids], pa.string()),
                    ], fields=list(DIGEST)))
                else:
                    done.append(pa.StructArray.from_arrays(
                        [pa.array(ids, pa.list_(pa.int32())), pa.array([vocab.decode(x) for x in ids], pa.string())], fields=list(KIND)
                    ))
            yield joined(done, DIGEST if digests else KIND)

    return id_and_text(docs, id_col, text_col).withColumn("r", run("text")).select("doc_id", "r.*")
