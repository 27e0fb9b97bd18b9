"""Substring deduplication by relative Lempel-Ziv parsing.

Every run of WINDOW words belongs to an anchor: of its sub-runs of ANCHOR_WORDS
words the one with the least hash, so equal runs have equal anchors wherever
they stand. Neighbouring runs with one anchor form a segment. The segments of
an anchor meet, in ascending order of their documents, at that anchor's
reference block: each is greedily factored against what smaller documents have
left there, and a factor of WINDOW words or more is a duplicate span. After a
factor the parse goes on at the next run, not the next word, so that runs
across a factor's boundary are looked up too.

Pass 1 counts which anchors occur in two documents, as sums that shrink before
they shuffle, and packs them into a bitmap of at most 2**MAX_BITS bits; pass 2
brings together only segments whose anchor is set there. A full bitmap costs
shuffle, never a result. Equal segments are one row, whatever their number. The
segments of an anchor in more than CROWD documents are taken apart into single
runs, each of which is its own anchor, so that no reference block grows large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, cut, discard, id_and_text, joined, let_go, text_slices
from .exact import filter_bits

WINDOW, ANCHOR_WORDS = 13, 5
SPAN = WINDOW - ANCHOR_WORDS + 1
#: In more documents than this, an anchor's runs are compared one by one instead of in its reference block.
CROWD = 2000
SECOND = np.random.default_rng(17).integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)
FACTORS = np.random.default_rng(13).integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)
LAST = (1 << 63) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _run_hashes(words: np.ndarray, length: int, factors: np.ndarray = FACTORS) -> np.ndarray:
    n = len(words) - length + 1
    total = words[:n] * factors[0]
    for j in range(1, length):
        total = total + words[j : j + n] * factors[j]
    return _mixed(total + np.uint64(length))


#: The hash of the empty word, which stands between two neighbouring blanks.
NO_WORD = np.uint64(xxhash.xxh64_intdigest(b"", seed=42))


def word_hashes(text: Column) -> Column:
    """The hashes of a text's words as an array, with some of NO_WORD between them; tasks get these in place of texts."""
    return F.transform(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ", -1), lambda w: F.xxhash64(w))


def hashed_texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each row of an Arrow list array."""
    bounds, values = np.asarray(column.offsets), np.asarray(column.values).view(np.uint64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = values[a:b]
        yield own[own != NO_WORD]


class Segments:
    """Finds the segments of texts; remembers the hashes of words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def words(self, text: str) -> np.ndarray:
        words, get = text.encode("utf-8", "replace").split(), self.known.get
        found = list(map(get, words))
        if None in found:
            if len(self.known) > CACHE_WORDS:
                self.known = {}
            new = {w: xxhash.xxh64_intdigest(w) for w, h in zip(words, found, strict=True) if h is None}
            self.known.update(new)
            found = [new[w] if h is None else h for w, h in zip(words, found, strict=True)]
        return np.array(found, np.uint64)

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, first run, number of runs) of each segment, for at least WINDOW words."""
        h = _run_hashes(words, ANCHOR_WORDS)
        n = len(words) - WINDOW + 1
        least, where = h[:n].copy(), np.arange(n)
        for j in range(1, SPAN):
            other = h[j : j + n]
            less = other < least
            least[less] = other[less]
            where[less] = np.flatnonzero(less) + j
        starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        return least[starts].view(np.int64), starts, np.diff(np.r_[starts, n])


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, words) to (anchor, doc), each anchor of a document once."""
    finder = Segments()
    for batch in batches:
        docs, anchors, owners = np.asarray(batch.column(0)), [], []
        for k, words in enumerate(hashed_texts(batch.column(1))):
            if len(words) >= WINDOW:
                found = np.unique(finder.of(words)[0])
                anchors.append(found)
                owners.append(np.full(len(found), docs[k]))
        if anchors:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors)), pa.array(np.concatenate(owners))], ["anchor", "doc"])


def unpacked(maps: list[tuple[int, bytes]], bits: int) -> np.ndarray:
    """The bitmaps of Spark's bitmap functions as one boolean array."""
    out = np.zeros(bits // 8, np.uint8)
    for bucket, body in maps:
        at = (bucket - 1) * 4096
        out[at : at + len(body)] = np.frombuffer(body, np.uint8)
    return out


#: Runs of several documents that leave a task together, at least.
MOST_RUNS = 4_000_000


def packed(rows: list[list]) -> pa.RecordBatch:
    anchor, n, hashes, doc, key, start = map(np.concatenate, rows)
    ends = np.r_[0, np.cumsum(n)]
    runs = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(hashes.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(anchor), runs, pa.array(doc), pa.array(key), pa.array(start.astype(np.int32))], ["anchor", "runs", "doc", "row_key", "at"])


def segment_rows(bitmaps, bits: int):
    """(doc, row_key, words) to the segments whose anchor is in the first bitmap, as (anchor, runs, doc, row_key, at).

    Those whose anchor is in the second bitmap too are given as single runs.
    """

    def is_set(maps: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        place = anchor & (bits - 1)
        return (maps[place >> 3] >> (place & 7)) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, (shared, crowd) = Segments(), bitmaps.value
        for batch in batches:
            docs, keys = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            rows: list[list] = [[], [], [], [], [], []]
            held = 0
            for k, words in enumerate(hashed_texts(batch.column(2))):
                if held > MOST_RUNS:
                    yield packed(rows)
                    rows, held = [[], [], [], [], [], []], 0
                if len(words) >= WINDOW:
                    anchor, start, n = finder.of(words)
                    some = is_set(shared, anchor)
                    if not some.any():
                        continue
                    hashes = _run_hashes(words, WINDOW).view(np.int64)
                    anchor, start, n = anchor[some], start[some], n[some]
                    many = is_set(crowd, anchor)
                    if many.any():
                        single = np.repeat(start[many] - np.r_[0, np.cumsum(n[many])[:-1]], n[many]) + np.arange(n[many].sum())
                        # A single run's anchor is a hash of its own: the two are independent, as with other anchors.
                        anchor = np.r_[anchor[~many], _run_hashes(_mixed(words), WINDOW, SECOND).view(np.int64)[single]]
                        start, n = np.r_[start[~many], single], np.r_[n[~many], np.ones(len(single), np.int64)]
                    take = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    for column, values in zip(rows, (anchor, n, hashes[take], np.full(len(n), docs[k]), np.full(len(n), keys[k]), start), strict=True):
                        column.append(values)
                    held += len(take)
            if rows[0]:
                yield packed(rows)

    return run


def factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, first_doc, runs, segment), in that order, to (anchor, segment, first_doc, mask): bit k is set if run k is in a smaller document."""
    anchor, block = None, {}
    for batch in batches:
        masks = []
        for a, doc, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if a != anchor:
                anchor, block = a, {}
            masks.append(parse(runs, doc, block))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(1), pa.array(masks, pa.int32())], ["anchor", "segment", "first_doc", "mask"])


def parse(runs: bytes, doc: int, block: dict[bytes, tuple[int, bytes]]) -> int:
    """Greedy parse of one segment against its anchor's reference block, to which it is then added.

    ``block`` leads from each run to the smallest document that has it, with
    what follows it in that segment, so that one lookup yields a whole factor.
    """
    mask, k, n = 0, 0, len(runs) // 8
    while k < n:
        found = block.get(runs[8 * k : 8 * k + 8])
        if found is None or found[0] >= doc:
            k += 1
            continue
        rest, length = found[1], 1
        while k + length < n and rest[8 * length : 8 * length + 8] == runs[8 * (k + length) : 8 * (k + length) + 8]:
            length += 1
        mask |= ((1 << length) - 1) << k
        k += length
    for k in range(n):
        block.setdefault(runs[8 * k : 8 * k + 8], (doc, runs[8 * k :]))
    return mask


def duplicate_runs(rows: DataFrame, expected: int) -> DataFrame:
    """(marked_doc, marked, spans) for each doc and row_key of ``rows`` (doc, row_key, text) with runs that a smaller document has."""
    spark = rows.sparkSession
    bits = filter_bits(expected)
    anchors = rows.select("doc", word_hashes(F.col("text")).alias("words")).mapInArrow(anchor_rows, "anchor long, doc long")
    shared = anchors.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("n")).where("a < b")
    place = F.col("anchor").bitwiseAND(F.lit(bits - 1)) + 1
    crowd = F.col("n") > CROWD
    maps = shared.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("body"),
        F.bitmap_construct_agg(F.when(crowd, F.bitmap_bit_position(place))).alias("crowd"),
    )
    found = maps.collect()  # two bitmaps of 16 MB at most
    bitmaps = spark.sparkContext.broadcast(tuple(unpacked([(r.bucket, bytes(r[k])) for r in found], bits) for k in (1, 2)))
    del found, maps, shared, anchors

    segments = cut(
        rows.select("doc", "row_key", word_hashes(F.col("text")).alias("words")).mapInArrow(segment_rows(bitmaps, bits), "anchor long, runs binary, doc long, row_key long, at int"),
        "segments",
    )
    let_go(spark)
    kinds = segments.groupBy("anchor", "runs").agg(F.min("doc").alias("first_doc")).withColumn("segment", F.xxhash64("runs"))
    blocks = kinds.select("anchor", "first_doc", "runs", "segment").repartition("anchor").sortWithinPartitions("anchor", "first_doc", "segment")
    decided = cut(blocks.mapInArrow(factored, "anchor long, segment long, first_doc long, mask int"), "decided")
    del kinds, blocks
    let_go(spark)
    places = segments.select("anchor", F.xxhash64("runs").alias("segment"), "doc", "row_key", "at", F.expr("shiftleft(1, cast(length(runs) / 8 as int)) - 1").alias("whole"))
    spans = (
        places.join(decided, ["anchor", "segment"])
        .select("doc", "row_key", "at", F.when(F.col("doc") > F.col("first_doc"), F.col("whole")).otherwise(F.col("mask")).alias("mask"))
        .where("mask <> 0")
    )
    found = cut(spans.groupBy(F.col("doc").alias("marked_doc"), F.col("row_key").alias("marked")).agg(F.collect_set(F.struct("at", "mask")).alias("spans")), "spans")
    discard(segments)
    discard(decided)
    del spans, places
    let_go(spark)
    return found


def remove_words(text: str, spans: list[dict] | None) -> tuple[int, list[bytes]]:
    """Number of words, and those outside the marked runs."""
    words = text.encode("utf-8", "replace").split()
    if not spans:
        return len(words), words
    edge = np.zeros(len(words) + WINDOW + 1, np.int64)
    for s in spans:
        for k in range(SPAN):
            if s["mask"] >> k & 1:
                edge[s["at"] + k] += 1
                edge[s["at"] + k + WINDOW] -= 1
    covered = np.cumsum(edge)[: len(words)] > 0
    return len(words), [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, and kept (or kept_sha256 with ``digests``).

    Removed is every word covered by a run of WINDOW words that also starts in
    a document with a smaller id; kept words are joined by one space. Words
    are compared unchanged, by two 64-bit hashes: of the run and of its anchor
    or, under a crowded anchor, of the run again, independently.
    Null texts have no words; texts under WINDOW words keep all. A null id
    ranks after every other, and rows with the same id do not count as each
    other's predecessors. Repeated rows get the same answer each; an empty
    table gives an empty result; other columns are not read.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text"))
    # One anchor in five words, a word in six characters.
    expected = docs.select(F.sum(F.length(F.col(text_col))).alias("n")).first()["n"] or 0
    spans = duplicate_runs(rows, expected // 30 // 4 + 1)

    body = "kept_sha256" if digests else "kept"
    out = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), (body, pa.string())])

    @F.arrow_udf(f"n_words long, n_removed long, {body} string")
    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, marks in batches:
            done = []
            for at, part in text_slices(texts):
                found = [remove_words(t, s) for t, s in zip(part, marks.slice(at, len(part)).to_pylist(), strict=True)]
                bodies = [b" ".join(kept) for _, kept in found]
                done.append(pa.StructArray.from_arrays([
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([n - len(kept) for n, kept in found], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() if digests else b.decode() for b in bodies], pa.string()),
                ], fields=list(out)))
            yield joined(done, out)

    marked = rows.select("doc_id", "doc", "text", "row_key").join(spans, (F.col("row_key") == F.col("marked")) & (F.col("doc") == F.col("marked_doc")), "left")
    return marked.withColumn("r", apply("text", "spans")).select("doc_id", "r.*")
