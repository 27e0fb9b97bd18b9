"""Near copies by shingle similarity: SimHash BK-trees in shards of shared shingles, verified exactly.

Texts are sharded by BANDS keys, each of ROWS independent least shingle
hashes: of pairs whose similarity is SIMILARITY, all but (1 - SIMILARITY **
ROWS) ** BANDS share a shard, whatever the table's size. A shard's fingerprints
form a BK-tree; what a search finds within RADIUS bits is verified by the exact
similarity of the two shingle sets, unless links found before already join
the two. Fingerprints are taken of the sets, as the similarity is: how often
a shingle repeats moves no bit. Texts are told apart by 128-bit hashes. Which
keys several texts share goes to the tasks as a bitmap of at most 16 MB; a full
bitmap costs shuffle, never a result.
"""

from __future__ import annotations

import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, text_slices, unused
from .components import components
from .exact import filter_bits
from .near_dups import SEARCHES, _merge, forest
from .substring import Segments, _mixed, _run_hashes, unpacked

WORDS, SIMILARITY, RADIUS = 5, 0.8, 20
BANDS, ROWS = 8, 2
#: A task gives a text that it meets again only once, as far as it remembers the last so many.
REMEMBERED = 100_000
_rnd = np.random.default_rng(11)
TURNS = _rnd.integers(1, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
SHIFTS = _rnd.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
#: A shard's searches hold at most so many hits at once (or those of one search); its sets, so many bytes in memory.
HITS, HELD = 1_000_000, 64_000_000


class Sketches:
    """Shingle sets of texts, their fingerprints and their least hashes."""

    def __init__(self) -> None:
        self.finder = Segments()

    def shingles(self, text: str) -> np.ndarray:
        """Hashes of the runs of WORDS words, lower-cased, in order; of fewer words, of all of them; none: none."""
        words = self.finder.words(text.lower())
        return _run_hashes(words, min(WORDS, len(words))) if len(words) else np.zeros(0, np.uint64)

    @staticmethod
    def keys(hashes: np.ndarray) -> np.ndarray:
        """One key for each band of a set that isn't empty."""
        if not len(hashes):
            return np.zeros(0, np.int64)
        step = max(1, 1_000_000 // len(TURNS))
        least = np.min([(hashes[k : k + step] * TURNS + SHIFTS).min(axis=1) for k in range(0, len(hashes), step)], axis=0).reshape(BANDS, ROWS)
        total = np.arange(1, BANDS + 1, dtype=np.uint64)
        for j in range(ROWS):
            total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) ^ least[:, j])
        return total.view(np.int64)

    @staticmethod
    def fingerprint(hashes: np.ndarray) -> int:
        ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * ones > len(hashes)).view(np.int64)[0])


class Seen:
    """Whether a text was met before, as far as remembered."""

    def __init__(self) -> None:
        self.keys: set[bytes] = set()

    def __call__(self, key: bytes) -> bool:
        if key in self.keys:
            return True
        if len(self.keys) >= REMEMBERED:
            self.keys.clear()
        self.keys.add(key)
        return False


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, text) to (key, text_key)."""
    sketches, seen = Sketches(), Seen()
    for batch in batches:
        owners = batch.column(0).to_pylist()
        for at, part in text_slices(batch.column(1)):
            keys, own = [], []
            for k, text in enumerate(part, at):
                if not seen(owners[k]):
                    found = sketches.keys(np.unique(sketches.shingles(text)))
                    keys.append(found)
                    own += [owners[k]] * len(found)
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(own, pa.binary())], ["key", "text_key"])


def sketch_rows(shared, bits: int):
    """(text_key, text) to (shard, text_key, fp, body) for every key that other texts share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches, seen, maps = Sketches(), Seen(), shared.value
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary())
        for batch in batches:
            owners = batch.column(0).to_pylist()
            for at, part in text_slices(batch.column(1)):
                rows: list[tuple[int, bytes, int, bytes]] = []
                for k, text in enumerate(part, at):
                    if seen(owners[k]):
                        continue
                    own = np.unique(sketches.shingles(text))
                    keys = sketches.keys(own)
                    keys = keys[maps[(keys & (bits - 1)) >> 3] >> (keys & 7) & 1 == 1]
                    if len(keys):
                        fp, body = sketches.fingerprint(own), own.tobytes()
                        rows += [(int(s), owners[k], fp, body) for s in keys]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "text_key", "fp", "body"])

    return run


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= SIMILARITY * (len(a) + len(b) - shared)


class Bodies:
    """The shingle sets of a shard, in memory up to HELD bytes, beyond that in a file without a name."""

    def __init__(self) -> None:
        self.file, self.ends = tempfile.SpooledTemporaryFile(max_size=HELD), array("q", [0])

    def append(self, body: bytes) -> None:
        self.file.write(body)
        self.ends.append(self.ends[-1] + len(body))

    def __getitem__(self, k: int) -> np.ndarray:
        self.file.seek(self.ends[k])
        return np.frombuffer(self.file.read(self.ends[k + 1] - self.ends[k]), np.uint64)


def _found(who: np.ndarray, prints: np.ndarray, edges: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs within RADIUS of the rows ``who`` and smaller ones, by the BK-tree."""
    node = np.zeros(len(who), np.int64)
    left, right = [], []
    while len(who):
        far = np.bitwise_count(prints[who] ^ prints[node]).astype(np.int64)
        near = (far <= RADIUS) & (node < who)
        left.append(who[near])
        right.append(node[near])
        low = np.searchsorted(edges, node * 65 + np.maximum(far - RADIUS, 0))
        count = np.searchsorted(edges, node * 65 + np.minimum(far + RADIUS, 64), side="right") - low
        at = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        who, node = np.repeat(who, count), child[at]
    left, right = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((right, left))
    return left[order], right[order]


def _tried(label: np.ndarray, left: np.ndarray, right: np.ndarray, bodies) -> np.ndarray:
    """The labels after every row tries its least neighbour that no link joins to it yet, all rows at once, until none is left."""
    while len(left):
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
        first = np.flatnonzero(np.r_[True, left[1:] != left[:-1]]) if len(left) else np.zeros(0, np.int64)
        good = np.array([similar(bodies[a], bodies[b]) for a, b in zip(left[first].tolist(), right[first].tolist(), strict=True)], bool)
        label = _merge(label, left[first][good], right[first][good])
        left, right = np.delete(left, first), np.delete(right, first)
    return label


def _parts(rows: np.ndarray, each: int) -> Iterator[np.ndarray]:
    """``rows`` in parts whose hits are at most HITS if each row has at most ``each``."""
    step = max(1, HITS // max(1, each))
    return (rows[k : k + step] for k in range(0, len(rows), step))


def verified_links(prints: np.ndarray, bodies) -> np.ndarray:
    """For each row of one shard the least row that it reaches by verified links.

    A row that is linked to the first row of the largest group so far meets
    only what lies outside that group: a family is not searched by all its
    pairs, and no link between groups is left out.
    """
    n = len(prints)
    label = np.arange(n)
    edges, child, _ = forest(prints, np.zeros(n, np.int64))
    for k in range(0, n, SEARCHES):
        rest = who = np.arange(k, min(n, k + SEARCHES))
        if k:
            main = int(np.bincount(label[:k]).argmax())
            close = who[np.bitwise_count(prints[who] ^ prints[main]) <= RADIUS]
            own = bodies[main]
            joined = close[np.array([similar(bodies[x], own) for x in close.tolist()], bool)]
            label = _merge(label, joined, np.full(len(joined), main))
            against = np.r_[np.flatnonzero(label[:k] != main), who]
            for part in _parts(joined, len(against)):
                near = (np.bitwise_count(prints[part][:, None] ^ prints[against]) <= RADIUS) & (against < part[:, None])
                left, right = np.nonzero(near & (label[part][:, None] != label[against]))
                label = _tried(label, part[left], against[right], bodies)
            rest = np.setdiff1d(who, joined, assume_unique=True)
        for part in _parts(rest, n):
            label = _tried(label, *_found(part, prints, edges, child), bodies)
    return label


def shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition's shards; rows in order of shard and text_key."""
    shard, keys, prints, bodies = None, [], array("q"), Bodies()

    def solve() -> pa.RecordBatch | None:
        if len(keys) < 2:
            return None
        label = verified_links(np.array(prints, np.int64).view(np.uint64), bodies)
        moved = np.flatnonzero(label != np.arange(len(keys))).tolist()
        return pa.RecordBatch.from_arrays([pa.array([keys[k] for k in moved], pa.binary()), pa.array([keys[label[k]] for k in moved], pa.binary())], ["u", "v"]) if moved else None

    for batch in batches:
        for s, key, fp, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != shard:
                if made := solve():
                    yield made
                shard, keys, prints, bodies = s, [], array("q"), Bodies()
            if not keys or keys[-1] != key:
                keys.append(key)
                prints.append(fp)
                bodies.append(body)
    if made := solve():
        yield made


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each group of equal or near-equal texts the least id.

    Texts are linked if their sets of five-word shingles, lower-cased, have a
    Jaccard similarity of 0.8 or more; groups are connected by links. Null and
    wordless texts equal each other if identical (null: empty). A row with a
    null id stays only in a group of null ids. Rows that repeat the id that
    stays are all kept. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    name, losing_key, kept_id, last = *(unused(docs, n) for n in ("__text_key", "__losing", "__keep")), F.lit((1 << 63) - 1)
    rows = docs.withColumn(name, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    texts = rows.select(F.col(name).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits = filter_bits(BANDS * docs.count())
    keys = texts.mapInArrow(key_rows, "key long, text_key binary").groupBy("key").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b"))
    place = F.col("key").bitwiseAND(F.lit(bits - 1)) + 1
    maps = keys.where("a <> b").groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("body")).collect()
    shared = spark.sparkContext.broadcast(unpacked([(r.bucket, bytes(r.body)) for r in maps], bits))
    sketches = texts.mapInArrow(sketch_rows(shared, bits), "shard long, text_key binary, fp long, body binary")
    edges = sketches.repartition("shard").sortWithinPartitions("shard", "text_key").mapInArrow(shard_links, "u binary, v binary")
    found = components(edges).select("node", "component")
    ids = rows.select(F.coalesce(F.col(id_col).cast("long"), last).alias("id"), F.col(name).alias("text_key"))
    own = ids.groupBy("text_key").agg(F.min("id").alias("id"), F.count("*").alias("n")).join(found, F.col("text_key") == F.col("node"), "left")
    own = cut(own.select("text_key", "id", "n", F.coalesce("component", "text_key").alias("group"), F.col("node").isNotNull().alias("linked")), "texts")
    least = own.where("linked").groupBy("group").agg(F.min("id").alias("keep"))
    # Only texts of which some row goes are listed; all other rows pass by the join.
    losing = own.where("linked or n > 1").join(least, "group", "left").select(F.col("text_key").alias(losing_key), F.coalesce("keep", "id").alias(kept_id))
    losing = cut(losing, "losing")
    discard(own)
    out = rows.join(losing, F.col(name) == F.col(losing_key), "left")
    return out.where(F.col(losing_key).isNull() | (F.coalesce(F.col(id_col).cast("long"), last) == F.col(kept_id))).select(*[F.col(f"`{c}`") for c in docs.columns])
