"""Secret scanning: an Aho-Corasick prefilter, anchored expressions near its hits, embedded checksums.

One automaton pass over the bytes of a text finds every keyword; an
expression is tried only where a keyword begins, and never twice over the same
characters. Runs of hexadecimal digits, which have no keyword, are found as
long runs in a byte-class table. Tokens that carry a checksum of themselves
count only if it is right.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, joined, text_slices

# Keywords, expressions, kinds in their order, and the digits of a checked token's checksum.
KEYWORDS = {
    b"password": "assign", b"passwd": "assign", b"secret": "assign", b"token": "assign", b"apikey": "assign", b"api_key": "assign",
    b"akia": "access", b"ghp_": "github", b"gho_": "github", b"ghu_": "github", b"ghs_": "github", b"ghr_": "github", b"npm_": "npm",
}
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KINDS = ("assign", "access", "hex", "github", "npm")
DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

HEX = np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True


def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        made.add_word(word.decode("latin-1"), (kind, len(word)))
    made.make_automaton()
    return made


def checksum_holds(body: bytes, digits: bytes) -> bool:
    """The last six base-62 digits of a token are the CRC-32 of the thirty before them."""
    value = 0
    for d in digits:
        value = value * 62 + DIGITS.index(d)
    return value == zlib.crc32(body)


def hex_runs(raw: bytes) -> list[tuple[int, int]]:
    """Maximal runs of at least MIN_HEX hexadecimal digits."""
    flags = np.zeros(len(raw) + 2, np.int8)
    flags[1:-1] = HEX[np.frombuffer(raw, np.uint8)]
    step = np.diff(flags)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - start >= MIN_HEX
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def find_secrets(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """Sorted (start, end, kind) in code points, end exclusive."""
    raw = text.encode("utf-8", "replace")
    found = [(a, b, "hex") for a, b in hex_runs(raw)]
    free = {"assign": 0, "access": 0, "github": 0, "npm": 0}
    for last, (kind, size) in words.iter(raw.lower().decode("latin-1")):
        at = last - size + 1
        if at < free[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(raw, at)
            good = m and len(m[1]) >= MIN_ASSIGN
        elif kind == "access":
            m = ACCESS.match(raw, at)
            good = m and m.end() - at >= MIN_ACCESS
        else:
            m = CHECKED.match(raw, at)
            good = m and checksum_holds(m[1], m[2])
        if m:
            free[kind] = m.end()
        if good:
            found.append((at, m.end(), kind))
    if found and len(raw) != len(text):  # byte places to code points
        before = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
        found = [(int(before[a]), int(before[b]), k) for a, b, k in found]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


OUT = pa.struct([
    ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()),
])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined).

    The three base kinds are as their expressions find them, leftmost and not
    overlapping within a kind; short matches are dropped. Tokens with a right
    checksum are added as kinds github and npm. Null texts count as empty and
    have no spans; null ids and repeated rows are answered like others; an
    empty table gives an empty result. Nothing shuffles, other columns are not
    read.
    """

    @F.arrow_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = automaton()
        for texts in batches:
            done = []
            for _, part in text_slices(texts):
                all_spans = [find_secrets(t, words) for t in part]
                counts = [pa.array([sum(s[2] == k for s in spans) for spans in all_spans], pa.int64()) for k in KINDS[:3]]
                base = [hashlib.sha256(listed([s for s in spans if s[2] in KINDS[:3]]).encode()).hexdigest() for spans in all_spans]
                done.append(pa.StructArray.from_arrays([*counts, pa.array(base, pa.string()), pa.array(list(map(listed, all_spans)), pa.string())], fields=list(OUT)))
            yield joined(done, OUT)

    return id_and_text(docs, id_col, text_col).withColumn("r", scan("text")).select("doc_id", "r.*")
