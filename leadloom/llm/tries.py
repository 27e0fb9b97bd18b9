"""A trie of conversation prefixes, built as a burst trie over Spark tables.

Conversations are rows of (conversation, depth, turn id), never lists: one of
any length is no group that a task must hold. Identical conversations become
one sequence with a weight first. Under the root all sequences form one
container of suffixes. A container that is too large for a task is burst by its
next turn ids: its top becomes a head of the trie, with a container for each next
turn. Rounds burst 1, 2, 4, ... turns further, so their number grows with the
logarithm of the deepest head, and each touches only the sequences still in
large containers. What remains is dealt by container to tasks, sorted, and swept
into nodes. A container of one sequence has no branch and needs no sweep.

A node is told by its depth and 128 bits: the exclusive or of the hashes of
(depth, turn id) along its path. Those are sums in any order, so they are partial
before they shuffle, and a parent's bits are a node's without its last turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import numbered
from .common import cut, discard

#: Conversations of FAMILY ids share the first of them; how many of its turns, at most, follows from an id: 0 to TURNS - 1.
FAMILY, TURNS = 5, 9
#: A container of more turns than this, and more than one sequence, is burst.
CONTAINER = 2000
#: Digest of the ids of no conversation.
NONE = hashlib.sha256(b"").hexdigest()


def _bits() -> list[Column]:
    """What a turn at its depth adds to its path's 128 bits."""
    return [F.xxhash64("depth", "x", F.lit(k)).alias(n) for k, n in ((1, "da"), (2, "db"))]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, x, y, bytes): every turn's place from 1, the 128 bits of its id (role and text), the UTF-8 bytes of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    one = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.xxhash64(role, text).alias("x"), F.xxhash64(F.lit("turn"), text, role).alias("y"), F.octet_length(text).cast("long").alias("bytes")
    )
    return numbered(one, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("x"), F.col("y")], "pos").select("conv_id", "pos", "x", "y", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, x, y, bytes) of the rebuilt conversations, and (conv) of all, those without turns too."""
    sizes = cut(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(TURNS))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = sizes.select("conv_id", base.alias("base"), shared.alias("h")).where("base <> conv_id")
    own = own.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    own = cut(own.select("base", F.col("conv_id").alias("conv"), "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("begun")), "own")
    heads = turns.where(F.col("pos") < TURNS).join(own, F.col("conv_id") == F.col("base")).where("pos <= h")
    # The first of a family is as it was; the others go on after their first h turns.
    rest = turns.join(own.drop("base"), F.col("conv_id") == F.col("conv"), "left").where("conv is null or pos > h")
    depth = F.when(F.col("conv").isNull(), F.col("pos")).otherwise(F.col("pos") - F.col("h") + F.col("begun"))
    rows = rest.select(F.col("conv_id").alias("conv"), depth.cast("long").alias("depth"), "x", "y", "bytes").unionByName(
        heads.select("conv", F.col("pos").cast("long").alias("depth"), "x", "y", "bytes")
    )
    return rows, sizes.select(F.col("conv_id").alias("conv"))


def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal (len, a, b), ids ascending, to pieces of joined ids."""
    names = ["len", "a", "b", "first", "piece"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        out = []
        for key, rows in groupby(zip(*[c.to_pylist() for c in batch.columns], strict=True), key=lambda r: r[:3]):
            ids = [r[3] for r in rows]
            out.append((*key, ids[0], ",".join(map(str, ids))))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to one digest a key; only the digest's state is held."""
    kind = pa.schema([("len", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends", pa.string())])
    key, state = None, None
    for batch in batches:
        out = []
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:3] != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = row[:3], hashlib.sha256()
            else:
                state.update(b",")
            state.update(row[4].encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kind.types)], kind.names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, state.hexdigest()), kind.types, strict=True)], kind.names)


def sequences(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a different sequence: rep (its least conversation), len, a, b, w (conversations), ends (digest of their ids)."""
    own = rows.select("conv", *_bits()).groupBy("conv").agg(F.count("*").alias("len"), F.bit_xor("da").alias("a"), F.bit_xor("db").alias("b"))
    whole = cut(convs.join(own, "conv", "left").select("conv", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("len", "a", "b")]), "whole")
    kinds = cut(whole.groupBy("len", "a", "b").agg(F.min("conv").alias("rep"), F.count("*").alias("w")), "kinds")
    # A sequence's ids are joined in ranges, and only the pieces meet in one task, which no digest can do without.
    many = whole.join(kinds.where("w > 1").select("len", "a", "b"), ["len", "a", "b"])
    pieces = many.select("len", "a", "b", "conv").repartitionByRange("len", "a", "b", "conv").sortWithinPartitions("len", "a", "b", "conv")
    pieces = pieces.mapInArrow(joined_ids, "len long, a long, b long, first long, piece string")
    found = pieces.repartition("len", "a", "b").sortWithinPartitions("len", "a", "b", "first").mapInArrow(digests, "len long, a long, b long, ends string")
    alone = F.sha2(F.col("rep").cast("string"), 256)
    return cut(kinds.join(found, ["len", "a", "b"], "left").select("rep", "len", "a", "b", "w", F.coalesce("ends", alone).alias("ends")), "sequences")


def burst(paths: DataFrame, kinds: DataFrame, root: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bursts containers until each has at most CONTAINER turns or one sequence.

    Returns ``heads`` (one row a node that was burst: depth, a, b, conv_id, n_convs, bytes, parent_conv, n_children),
    ``spine`` (rep, depth, a, b, head's conv_id, own: what the head saves if rep stands for it)
    and ``containers`` (rep, top: depth of its container's top, a, b, shared: whether others are in it, parent_conv).
    """
    zero = F.lit(0).cast("long")
    active = kinds.where("len > 0").select("rep", zero.alias("sa"), zero.alias("sb"), F.lit(root).cast("long").alias("last"))
    at, step, heads, spine, containers, children = 0, 1, [], [], [], []
    while True:
        near = paths.where((F.col("depth") > at) & (F.col("depth") <= at + step)).join(active, "rep")
        along = Window.partitionBy("rep").orderBy("depth")
        near = near.select(
            "rep", "depth", "bytes", "w", "len", "last", *_bits(),
            *[F.bit_xor(c).over(along).bitwiseXOR(F.col(s)).alias(n) for c, s, n in ((_bits()[0], "sa", "a"), (_bits()[1], "sb", "b"))],
        )
        near = cut(near, "near")
        nodes = near.groupBy("depth", "a", "b").agg(
            F.count("*").alias("n_seq"), F.sum("w").alias("n_convs"), F.min("rep").alias("conv_id"), F.sum(F.col("len") - F.col("depth") + 1).alias("turns"),
            F.max("bytes").alias("node_bytes"), F.max(F.col("a").bitwiseXOR(F.col("da"))).alias("pa"), F.max(F.col("b").bitwiseXOR(F.col("db"))).alias("pb"),
        )
        nodes = cut(nodes.withColumn("large", (F.col("n_seq") > 1) & (F.col("turns") > CONTAINER)), "nodes")
        met = cut(near.join(nodes, ["depth", "a", "b"]), "met")
        discard(near)
        children.append(nodes.select(F.col("depth") - 1, "pa", "pb").toDF("depth", "a", "b"))
        heads.append(nodes.where("large").select("depth", "a", "b", "conv_id", "n_convs", F.col("node_bytes").alias("bytes"), "pa", "pb"))
        spine.append(met.where("large").select("rep", "depth", "a", "b", "conv_id", F.when(F.col("rep") == F.col("conv_id"), (F.col("n_convs") - 1) * F.col("node_bytes")).otherwise(0).alias("own")))
        below = F.when(~F.col("large"), F.struct("depth", "a", "b", (F.col("n_seq") > 1).alias("shared")))
        over = F.when(F.col("large"), F.struct("depth", "a", "b", "conv_id"))
        each = cut(
            met.groupBy("rep").agg(F.min(below).alias("top"), F.max(over).alias("head"), F.max("last").alias("last"), F.max("len").alias("len")), "each"
        )
        parent = F.coalesce("head.conv_id", "last").alias("parent_conv")
        containers.append(each.where("top is not null").select("rep", "top.*", parent).withColumnRenamed("depth", "top"))
        at, step = at + step, step * 2
        active = cut(each.where(F.col("top").isNull() & (F.col("len") > at)).select("rep", F.col("head.a").alias("sa"), F.col("head.b").alias("sb"), parent.alias("last")), "active")
        if not active.limit(1).count():
            break
    whole = lambda parts: parts[0] if len(parts) == 1 else whole([parts[0].unionByName(parts[1]), *parts[2:]])
    counted = whole(children).groupBy("depth", "a", "b").agg(F.count("*").alias("n_children"))
    found, above = whole(heads), whole(heads).select((F.col("depth") + 1).alias("d"), F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("conv_id").alias("parent_conv"))
    up = (F.col("depth") == F.col("d")) & (F.col("pa") == F.col("ua")) & (F.col("pb") == F.col("ub"))
    found = found.join(above, up, "left").join(counted, ["depth", "a", "b"], "left")
    return (
        found.select("depth", "a", "b", "conv_id", "n_convs", "bytes", F.coalesce("parent_conv", F.lit(root)).alias("parent_conv"), "n_children"),
        whole(spine), whole(containers),
    )


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes of each container, sorted and swept into nodes.

    Rows: top, a, b, rep, depth, x, y, bytes, w, ends, parent_conv, in order of the
    first five. Each suffix opens the nodes beyond what it shares with the one
    before; from the last node back, counts then go to the node above.
    """
    kind = pa.schema([(n, pa.string() if n == "ends" else pa.int64()) for n in NODE])
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
    for _, container in groupby(rows, key=lambda r: r[:3]):
        suffixes = sorted((([(r[5], r[6]) for r in own], rep, own) for rep, own in ((rep, list(g)) for rep, g in groupby(container, key=lambda r: r[3]))), key=lambda s: s[:2])
        nodes: list[dict] = []
        path: list[int] = []
        before: list[tuple] = []
        for turns, rep, own in suffixes:
            k = 0
            while k < len(before) and k < len(turns) and before[k] == turns[k]:
                k += 1
            path, before = path[:k], turns
            for r in own[k:]:
                nodes.append({"up": path[-1] if path else None, "depth": r[4], "bytes": r[7], "conv_id": None, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved": 0, "ends": None})
                path.append(len(nodes) - 1)
            end = nodes[path[-1]]
            end["conv_id"], end["ends"] = rep, own[-1][9]
            end["n_convs"] += own[-1][8]
        for x in reversed(nodes):
            x["saved"] += (x["n_convs"] - 1) * x["bytes"]
            x["n_leaves"] = x["n_leaves"] or 1
            if x["up"] is not None:
                up = nodes[x["up"]]
                up["conv_id"] = x["conv_id"] if up["conv_id"] is None else min(up["conv_id"], x["conv_id"])
                up["n_children"] += 1
                for n in ("n_convs", "n_leaves", "saved"):
                    up[n] += x[n]
        for x in nodes:
            x["top"] = int(x["up"] is None)
            x["parent_conv"] = suffixes[0][2][0][10] if x["up"] is None else nodes[x["up"]]["conv_id"]
        yield pa.RecordBatch.from_pylist(nodes, kind)


NODE = ("conv_id", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends", "top")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of rebuilt conversations.

    Columns: conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Turns go by ``turn``, null first, those
    of one place by the hashes of role and text; null roles and texts count as
    empty. A conversation c takes the first turns of c - c % FAMILY (the
    remainder has c's sign); one that has none itself is no conversation. Rows
    without conv_id belong to none and are left out; rows that repeat are turns
    of their own. An empty table gives an empty result; other columns are not read.
    """
    turns = cut(turns_of(conversations), "turns")
    rows, convs = rebuilt(turns)
    rows = cut(rows, "rebuilt")
    kinds = sequences(rows, convs)
    n_convs, root = kinds.agg(F.sum("w"), F.min("rep")).first()
    paths = rows.join(kinds.select("rep", "len", "w", F.col("ends").alias("all_ends")), F.col("conv") == F.col("rep"))
    paths = cut(paths.select("rep", "depth", "x", "y", "bytes", "len", "w", F.when(F.col("depth") == F.col("len"), F.col("all_ends")).alias("ends")), "paths")
    discard(turns)
    discard(rows)
    heads, spine, containers = burst(paths, kinds, root)

    held = cut(paths.join(containers, "rep").where(F.col("depth") >= F.col("top")), "held")
    alone = held.where("not shared")
    more = Window.partitionBy("rep").orderBy(F.desc("depth"))
    zero = F.lit(0).cast("long")
    chains = alone.where("w = 1").withColumn("saved", zero).unionByName(alone.where("w > 1").withColumn("saved", (F.col("w") - 1) * F.sum("bytes").over(more)))
    is_top = (F.col("depth") == F.col("top")).cast("long")
    chains = chains.select(
        F.col("rep").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top"), F.col("parent_conv")).otherwise(F.col("rep")).alias("parent_conv"), F.col("w").alias("n_convs"),
        (F.col("depth") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), "saved", "ends", is_top.alias("top"),
    )
    dealt = held.where("shared").select("top", "a", "b", "rep", "depth", "x", "y", "bytes", "w", "ends", "parent_conv")
    dealt = dealt.repartition("top", "a", "b").sortWithinPartitions("top", "a", "b", "rep", "depth")
    swept = dealt.mapInArrow(sweep, ", ".join(f"{n} {'string' if n == 'ends' else 'long'}" for n in NODE))
    low = cut(chains.unionByName(swept), "low")

    tops = low.where("top = 1").select(F.col("conv_id").alias("rep"), "n_leaves", F.col("saved").alias("kept"))
    onward = Window.partitionBy("rep").orderBy(F.desc("depth"))
    under = spine.join(tops, "rep", "left").withColumn("below", F.sum("own").over(onward) + F.coalesce("kept", zero))
    sums = under.groupBy("depth", "a", "b").agg(F.sum("below").alias("saved"), F.sum(F.coalesce("n_leaves", zero)).alias("n_leaves"))
    ended = kinds.select(F.col("len").alias("depth"), "a", "b", "ends")
    high = heads.join(sums, ["depth", "a", "b"]).join(ended, ["depth", "a", "b"], "left").select(*NODE[:-1])
    found = low.select(*NODE[:-1]).unionByName(high)
    if root is not None:
        first, leaves, saved = low.where("depth = 1").count() + heads.where("depth = 1").count(), *tops.agg(F.sum("n_leaves"), F.sum("kept")).first()
        empty = kinds.where("len = 0").select("ends").first()
        row = (root, 0, None, n_convs, first, leaves or 1, (saved or 0) + (spine.agg(F.sum("own")).first()[0] or 0), empty[0] if empty else None)
        found = found.unionByName(conversations.sparkSession.createDataFrame([row], found.schema))
    return found.select(
        "conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NONE)).alias("ends_sha256")
    )
