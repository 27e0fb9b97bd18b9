"""Near-duplicates by SimHash fingerprints and BK-trees.

Fingerprints are brought together before they are compared: two that differ
in at most two bits agree on one of three blocks of bits, and of the bits left
on one of three smaller blocks, so each is sent to nine shards, and every pair
within the radius meets in one. A shard's fingerprints form a BK-tree, whose
children are keyed by their Hamming distance to the parent; a search follows
only the edges within the radius. A shard's tree goes to the one task that
holds its searches, not to every executor: together the trees are as large as
all fingerprints, and neither driver nor broadcast may hold those. A shard
gives back at most one link for each of its fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import cut, id_and_text, joined, text_slices
from .components import components

#: Words in a shingle, the hash's seed, and the most bits by which linked fingerprints differ.
SHINGLE_WORDS, SEED, RADIUS = 3, 42, 2
#: The nine shards: three blocks of the 64 bits, and three blocks of what each leaves.
BLOCKS = 3
#: Searches that walk the trees of a task side by side.
SEARCHES = 2048


def _bits(mask: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in mask))


def shard_masks() -> list[np.uint64]:
    """For each of the nine shards the bits that its fingerprints share."""
    masks = []
    for i in range(BLOCKS):
        own = [b for b in range(64) if b % BLOCKS == i]
        rest = [b for b in range(64) if b % BLOCKS != i]
        for j in range(BLOCKS):
            masks.append(_bits(own + [b for k, b in enumerate(rest) if k % BLOCKS == j]))
    return masks


def fingerprint_batch(texts: list[str], words_each: int = SHINGLE_WORDS) -> np.ndarray:
    """The unsigned 64-bit SimHash of every text; no words: zero."""
    digest, hashes, sizes = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = text.encode("utf-8", "replace").lower().split()
        if not words:
            sizes.append(0)
            continue
        body = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        k = min(words_each, len(words))
        found = [digest(body[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
        hashes.append(np.array(found, np.uint64))
        sizes.append(len(found))
    out = np.zeros(len(texts), np.uint64)
    sizes = np.array(sizes, np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.unpackbits(np.concatenate(hashes).astype(">u8").view(np.uint8)).reshape(-1, 64)
        starts = np.r_[0, np.cumsum(sizes[full])[:-1]]
        ones = np.add.reduceat(flat, starts, axis=0, dtype=np.int32)
        set_bits = (2 * ones > sizes[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(set_bits, axis=1).view(">u8")[:, 0].astype(np.uint64)
    return out


@F.arrow_udf(LongType())
def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield joined(
            [pa.array(fingerprint_batch(part).view(np.int64)) for _, part in text_slices(texts, 1_000_000)], pa.int64()
        )


def forest(prints: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all shards, level by level; rows of a shard are adjacent, its first row is the root.

    Returns (edges, child, depth_order): ``edges`` are the sorted keys
    parent * 65 + distance and ``child`` the row each leads to.
    """
    n = len(prints)
    parent = np.maximum.accumulate(np.where(np.r_[True, shard[1:] != shard[:-1]], np.arange(n), 0))
    wait = np.flatnonzero(parent != np.arange(n))
    edges, children = [], []
    while len(wait):
        far = np.bitwise_count(prints[wait] ^ prints[parent[wait]]).astype(np.int64)
        key = parent[wait] * 65 + far
        found, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        edges.append(found)
        children.append(wait[first])
        parent[wait] = wait[first][inverse]  # the rest go on below the child of their distance
        wait = wait[parent[wait] != wait]
    if not edges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), parent
    edges, children = np.concatenate(edges), np.concatenate(children)
    order = np.argsort(edges)
    return edges[order], children[order], parent


def links(prints: np.ndarray, shard: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row the least row of its shard that it reaches by steps within the radius."""
    n = len(prints)
    roots = np.maximum.accumulate(np.where(np.r_[True, shard[1:] != shard[:-1]], np.arange(n), 0))
    edges, child, _ = forest(prints, shard)
    label = np.arange(n)
    sizes = np.bincount(roots, minlength=n)[roots]
    searches = np.flatnonzero(sizes > 1)
    for k in range(0, len(searches), SEARCHES):
        who = searches[k : k + SEARCHES]
        node = roots[who]
        left, right = [], []
        while len(who):
            far = np.bitwise_count(prints[who] ^ prints[node]).astype(np.int64)
            near = (far <= radius) & (node < who)
            left.append(who[near])
            right.append(node[near])
            low = np.searchsorted(edges, node * 65 + np.maximum(far - radius, 0))
            high = np.searchsorted(edges, node * 65 + np.minimum(far + radius, 64), side="right")
            count = high - low
            at = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            who, node = np.repeat(who, count), child[at]
        label = _merge(label, np.concatenate(left), np.concatenate(right))
    return label


def _merge(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least labels after joining the sets of the given pairs."""
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return label
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition's shards, rows in shard order; a shard that goes on in the next batch waits for it."""
    held = np.zeros((0, 3), np.int64)

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        label = links(rows[:, 1].view(np.uint64), rows[:, 0])
        moved = label != np.arange(len(rows))
        return pa.RecordBatch.from_arrays([pa.array(rows[moved, 2]), pa.array(rows[label[moved], 2])], ["u", "v"])

    for batch in batches:
        rows = np.stack([np.asarray(batch.column(k)) for k in range(3)], axis=1).astype(np.int64)
        held = np.ascontiguousarray(np.concatenate([held, rows]))
        if len(held):
            whole = int(np.searchsorted(held[:, 0], held[-1, 0]))
            if whole:
                yield solve(np.ascontiguousarray(held[:whole]))
                held = held[whole:]
    if len(held):
        yield solve(np.ascontiguousarray(held))


def fingerprint_components(prints: DataFrame) -> DataFrame:
    """(fp, component_id) for each fingerprint of ``prints`` (doc_id, fp): the least doc_id it reaches, null ids left out."""
    groups = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "groups")
    shards = F.array(*[
        F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(int(mask.astype(np.int64))))) for k, mask in enumerate(shard_masks())
    ])
    spread = groups.where("node is not null").select(F.explode(shards).alias("shard"), "fp", "node")
    edges = spread.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(shard_links, "u long, v long")
    found = components(edges)
    return groups.join(found, "node", "left").select(
        F.col("fp").alias("linked_fp"), F.coalesce("component", "node").alias("component_id")
    )


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints that differ in at most RADIUS bits are linked; component_id is
    the least doc_id that a row reaches by links, itself included. Null and
    wordless texts have fingerprint zero, linked like any other. Rows with a
    null id get the component of their fingerprint and name none themselves
    (null if nobody does). Repeated rows are answered each; an empty table
    gives an empty result; other columns are not read.
    """
    prints = cut(id_and_text(docs, id_col, text_col).select("doc_id", fingerprint("text").alias("fp")), "prints")
    found = cut(fingerprint_components(prints), "components")
    return prints.join(found, F.col("fp") == F.col("linked_fp")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
