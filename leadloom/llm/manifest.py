"""A Merkle manifest of a dataset, and proofs of all its rows by octopus multiproofs.

Every row is a leaf; the leaves of a source, by id, are the lowest nodes of its
tree, FAN of which make a node of the next level; the roots of the sources
make one more tree. Rows are dealt by ranges of (source, id), so a range covers
consecutive leaves of one or more consecutive trees, and most nodes lie
inside it. Only the nodes of runs that a range shares with others are
written, at most 2 * FAN a level and range, and the trees are completed from those.

For the proofs a range lists the nodes next to its own, level by level, that its
leaves do not give: the least set from which all its paths can be derived. It
gets them in one join, derives the nodes that its paths share once, and spells
out each leaf's own proof from them.

A node's place is (tree, level, at): tree k is that of the k-th source, tree 0 the
one over the sources, in which the k-th source is at k - 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import numbered
from .common import cut, discard

#: Nodes that make one node of the next level; most leaves that a task holds at once; one of so many rows is tampered with.
FAN, RANGE, TAMPERED = 16, 20_000, 5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(value: Column) -> Column:
    """A value as the leaf holds it: its length in bytes, a colon and itself; null is a dash."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(names: list[str], text: Column) -> Column:
    return F.sha2(F.concat(*[field(F.col(n)) for n in names], field(text)), 256)


def node(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """The level of the root of a tree of n leaves."""
    level = 0
    while n > 1:
        n, level = -(-n // FAN), level + 1
    return level


def width(n: int, level: int) -> int:
    """How many nodes a tree of n leaves has at a level."""
    return -(-n // FAN**level)


def edges(lo: int, hi: int, n: int, level: int) -> tuple[range, range]:
    """Of a level, in a tree of n leaves, the nodes left and right of lo to hi in the same runs."""
    return range(lo // FAN * FAN, lo), range(hi + 1, min(hi // FAN * FAN + FAN, width(n, level)))


def missing(lo: int, hi: int, n: int) -> list[tuple[int, int]]:
    """(level, at) of the nodes that the paths of leaves lo to hi need and the leaves do not give."""
    out = []
    for level in range(height(n)):
        for side in edges(lo, hi, n, level):
            out += [(level, at) for at in side]
        lo, hi = lo // FAN, hi // FAN
    return out


def inside(leaves: list[str], lo: int, n: int) -> tuple[list[list[str]], list[tuple[int, int, str]], str | None]:
    """What consecutive leaves, the first at lo, give by themselves in a tree of n leaves.

    Returns the nodes of runs that reach beyond them, as (level, at, digest), and
    the root if the leaves are all of the tree.
    """
    shared, row, level = [], leaves, 0
    while row and width(n, level) > 1:
        hi = lo + len(row) - 1
        left, right = edges(lo, hi, n, level)
        # Runs that begin or end outside: their nodes go to whoever completes them.
        begin = -(-lo // FAN) * FAN if len(left) else lo
        end = (hi + 1) // FAN * FAN if len(right) else hi + 1
        if begin >= end:
            shared += [(level, lo + k, d) for k, d in enumerate(row)]
            return shared, None
        shared += [(level, lo + k, d) for k, d in enumerate(row[: begin - lo])]
        shared += [(level, end + k, d) for k, d in enumerate(row[end - lo :])]
        whole = row[begin - lo : end - lo]
        row = [node(whole[k : k + FAN]) for k in range(0, len(whole), FAN)]
        lo, level = begin // FAN, level + 1
    return shared, row[0] if row else None


def derived(leaves: list[str], lo: int, n: int, fetched: dict[tuple[int, int], str]) -> tuple[list[tuple[int, list[str]]], str]:
    """Level by level (the place of the first node, nodes) of all runs on the leaves' paths, and the root."""
    levels, row, level = [], leaves, 0
    hi = lo + len(row) - 1
    while width(n, level) > 1:
        left, right = edges(lo, hi, n, level)
        row = [fetched[level, at] for at in left] + row + [fetched[level, at] for at in right]
        levels.append((lo - len(left), row))
        row = [node(row[k : k + FAN]) for k in range(0, len(row), FAN)]
        lo, hi, level = lo // FAN, hi // FAN, level + 1
    return levels, row[0]


class Path:
    """The proofs of the nodes of a tree that :func:`derived` knows; what paths share is made once."""

    def __init__(self, levels: list[tuple[int, list[str]]], above: bytes = b"") -> None:
        self.levels, self.above, self.kept = levels, above, {}

    def run(self, level: int, at: int) -> list[str]:
        first, row = self.levels[level]
        begin = at // FAN * FAN - first
        return row[begin : begin + FAN]

    def siblings(self, level: int, at: int) -> bytes:
        """The digests beside a node and beside all above it, from below to the root."""
        if level == len(self.levels):
            return self.above
        run, own = self.run(level, at), at % FAN
        key = (level + 1, at // FAN)
        if key not in self.kept:
            self.kept[key] = self.siblings(*key)
        return "".join(run[:own] + run[own + 1 :]).encode() + self.kept[key]

    def fold(self, digest: str, at: int) -> str:
        """The root that follows if the leaf at a place has this digest."""
        for level in range(len(self.levels)):
            run, own = self.run(level, at), at % FAN
            digest, at = node([*run[:own], digest, *run[own + 1 :]]), at // FAN
        return digest


def _by(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows in order, by runs of equal keys."""
    rows = (r for b in batches for r in b.to_pylist())
    for key, group in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
        yield key, list(group)


def shared_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, level, at, digest, of) of what each range shares; the root of a tree that lies inside has the tree's height for level."""
    for (_, tree), rows in _by(batches, "part", "tree"):
        n = rows[0]["n"]
        shared, root = inside([r["leaf"] for r in rows], rows[0]["at"], n)
        if root is not None:
            shared.append((height(n), 0, root))
        yield pa.RecordBatch.from_pylist([{"tree": tree, "level": v, "at": a, "digest": d, "n": n} for v, a, d in shared], pa.schema([("tree", pa.int64()), ("level", pa.int64()), ("at", pa.int64()), ("digest", pa.string()), ("n", pa.int64())]))


def _wanted(spans: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, tree, level, at) of the nodes that each range's paths lack."""
    for b in spans:
        for r in b.to_pylist():
            found = missing(r["lo"], r["hi"], r["n"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["part"]] * len(found), pa.int64()), pa.array([r["tree"]] * len(found), pa.int64()), pa.array([v for v, _ in found], pa.int64()), pa.array([a for _, a in found], pa.int64())],
                ["part", "want_tree", "want_level", "want_at"],
            )


def completed(shared: DataFrame) -> DataFrame:
    """All nodes of ``shared`` (tree, level, at, digest, n) and those above them, up to each tree's root, level by level."""
    nodes = cut(shared, "nodes")
    known, level = [nodes], 0
    top = height(nodes.agg(F.max("n")).first()[0] or 0)
    row = nodes.where("level = 0")
    while level < top:
        made = row.groupBy("tree", F.floor(F.col("at") / FAN).alias("up"), "n").agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("run"))
        made = made.where(F.col("n") > F.lit(FAN**level)).select(
            "tree", F.lit(level + 1).cast("long").alias("level"), F.col("up").alias("at"), F.sha2(F.array_join(F.transform("run", lambda x: x["digest"]), ""), 256).alias("digest"), "n"
        )
        made = cut(made, "nodes")
        level += 1
        known.append(made)
        row = made.unionByName(nodes.where(F.col("level") == level))
    out = known[0]
    for more in known[1:]:
        out = out.unionByName(more)
    return out


def proofs(root: str | None):
    """Leaves of a piece and the nodes it fetched to one row a leaf: proof, and the root that follows from what it is now."""

    def run(key, leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        own, wanted = leaves.sort_by([("tree", "ascending"), ("at", "ascending")]).to_pylist(), {}
        for r in fetched.to_pylist():
            wanted.setdefault(r["tree"], {})[r["level"], r["at"]] = r["digest"]
        trees = [(tree, list(rows)) for tree, rows in groupby(own, key=lambda r: r["tree"])]
        known = [derived([r["leaf"] for r in rows], rows[0]["at"], rows[0]["n"], wanted.get(tree, {})) for tree, rows in trees]
        # The trees of a range follow one another, so their roots are consecutive leaves of the tree over the sources.
        tops = Path(derived([top for _, top in known], trees[0][0] - 1, own[0]["n_trees"], wanted.get(0, {}))[0])
        out = {k: [] for k in ("doc_id", "leaf", "subroot", "proof_sha256", "folded_root")}
        for (tree, rows), (levels, top) in zip(trees, known, strict=True):
            path, plain = Path(levels, tops.siblings(0, tree - 1)), {}
            for r in rows:
                run_of = r["at"] // FAN
                folded = None if r["changed"] else plain.get(run_of)
                if folded is None:
                    folded = tops.fold(path.fold(r["changed"] or r["leaf"], r["at"]), tree - 1)
                    if not r["changed"]:
                        plain[run_of] = folded  # leaves of a run that are as they were fold to the same node
                out["proof_sha256"].append(sha256(path.siblings(0, r["at"])).hexdigest())
                out["folded_root"].append(folded)
                out["doc_id"].append(r["doc_id"])
                out["leaf"].append(r["leaf"])
                out["subroot"].append(top)
        made = pa.table({k: pa.array(v, pa.int64() if k == "doc_id" else pa.string()) for k, v in out.items()})
        return made.append_column("root", pa.array([root] * len(made), pa.string()))

    return run


def manifest(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The leaf hashes doc_id, source, lang, n_chars and text; null values have a
    form of their own. Where TAMPERED divides the id's crc32 the text's A-Z
    are lower-cased before the root is recomputed (a null id is left alone);
    ``verified`` says whether the result still equals the root. Null ids come
    first in their source, the null source first of all; rows of one id follow
    by their leaves, so rows that repeat get the same proofs. An empty table
    gives an empty result; other columns are not read.
    """
    names = ["doc_id", "source", "lang", "n_chars"]
    one = docs.select(*[F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in names], F.col(text_col).alias("text"))
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(TAMPERED)) == 0
    changed = F.when(hit, leaf(names, F.translate("text", UPPER, UPPER.lower())))
    leaves = cut(one.select("doc_id", "source", leaf(names, F.col("text")).alias("leaf"), changed.alias("changed")), "leaves")
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    # Ranges are as many as Spark likes; each is taken in pieces that a task can hold.
    ranged = leaves.repartitionByRange(*order).withColumn("range", F.spark_partition_id().cast("long"))
    ranged = ranged.withColumn("k", F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1)
    ranged = cut(ranged.withColumn("part", F.shiftleft("range", 32) + F.floor(F.col("k") / RANGE)), "ranges")
    discard(leaves)

    # One row a piece and source says where its leaves stand.
    spans = ranged.groupBy("part", "source").agg(F.count("*").alias("size"), F.min("k").alias("first"))
    upto = Window.partitionBy("source").orderBy("part")
    spans = spans.select(
        "part", F.col("source").alias("named"), "size", "first", (F.sum("size").over(upto) - F.col("size")).alias("lo"), F.sum("size").over(Window.partitionBy("source")).alias("n")
    )
    trees = numbered(spans.select("named").distinct(), [], [F.col("named").asc_nulls_first()], "tree").withColumnRenamed("named", "called")
    spans = cut(spans.join(trees, F.col("named").eqNullSafe(F.col("called"))).drop("called"), "spans")
    n_trees = spans.agg(F.max("tree")).first()[0] or 0
    placed = ranged.join(spans.withColumnRenamed("part", "of"), (F.col("part") == F.col("of")) & F.col("source").eqNullSafe(F.col("named"))).select(
        "part", "tree", (F.col("lo") + F.col("k") - F.col("first")).alias("at"), "n", F.lit(n_trees).cast("long").alias("n_trees"), "doc_id", "leaf", "changed"
    )
    placed = cut(placed, "placed")
    discard(ranged)

    kind = "tree long, level long, at long, digest string, n long"
    shared = placed.select("part", "tree", "at", "n", "leaf").repartition("part").sortWithinPartitions("part", "tree", "at").mapInArrow(shared_nodes, kind)
    nodes = cut(completed(shared), "known")
    tops = nodes.join(trees_heights(spans), ["tree", "level"]).where("at = 0").select(F.lit(0).cast("long").alias("tree"), F.lit(0).cast("long").alias("level"), (F.col("tree") - 1).alias("at"), "digest", F.lit(n_trees).cast("long").alias("n"))
    over = cut(completed(tops), "over")
    found = over.where(F.col("level") == height(n_trees)).select("digest").first()
    root = found[0] if found else None

    ends = spans.groupBy("part").agg((F.min("tree") - 1).alias("lo"), (F.max("tree") - 1).alias("hi"))
    asked = spans.select("part", "tree", "lo", (F.col("lo") + F.col("size") - 1).alias("hi"), "n").unionByName(
        ends.select("part", F.lit(0).cast("long").alias("tree"), "lo", "hi", F.lit(n_trees).cast("long").alias("n"))
    )
    wanted = cut(asked.mapInArrow(_wanted, "part long, want_tree long, want_level long, want_at long"), "wanted")
    same = (F.col("tree") == F.col("want_tree")) & (F.col("level") == F.col("want_level")) & (F.col("at") == F.col("want_at"))
    fetched = wanted.join(nodes.unionByName(over), same).select("part", "tree", "level", "at", "digest")
    out = placed.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(
        proofs(root), "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string, root string"
    )
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def trees_heights(spans: DataFrame) -> DataFrame:
    """(tree, level) of each source's root: its height, by whole numbers."""
    level = F.lit(0)
    for k in range(16):  # FAN ** 15 is the last below 2 ** 63
        level = level + (F.col("n") > F.lit(min(FAN**k, (1 << 63) - 1))).cast("int")
    return spans.groupBy("tree").agg(F.max("n").alias("n")).select("tree", level.cast("long").alias("level"))
