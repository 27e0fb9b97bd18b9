"""Mixing sources to target weights by pivotal dependent rounding.

A source's target, shared by weight under a cap, says how many copies each of
its documents should have; the whole part of it is taken outright. What is
left is a fraction of each document. Two fractions meet at a time: words move
from one to the other, in a direction drawn so that neither gains on average,
until one of the two documents is wholly in or wholly out. The source's sum of
words never changes, so the mix misses its target by less than the one
document that stays open at the end.

Documents are dealt by hash into segments of about SEGMENT; every segment
leaves at most one open document, and those are combined FAN segments at a time,
level by level, until each source has one. A source of a third of all rows has a
third of all segments. All draws come from hashes of the rows, so reruns agree
however the rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import numbered
from .common import cut

#: Weights of the sources in order, repeating; the mix's share of all words; most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Documents in a segment, on average, and segments whose open documents are combined.
SEGMENT, FAN = 1024, 1024
MASK = (1 << 64) - 1

KIND = "sid long, seg long, h long, doc_id long, size long, source_size long, target double, copies long, mass double, open boolean"


def chance(one: int, other: int) -> float:
    """A number in [0, 1) that follows from two hashes."""
    x = (one * 0x9E3779B97F4A7C15 ^ (other + 0x632BE59BD9B4E019) * 0xD1342543DE82EF95) & MASK
    for _ in range(2):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & MASK
    return (x ^ x >> 32) / (MASK + 1)


def transfer(size: int, mass: float, other_size: int, other_mass: float, drawn: float) -> tuple[float, float]:
    """The words of two open documents after one of them is settled; their sum stays."""
    gain, loss = min(size - mass, other_mass), min(mass, other_size - other_mass)
    if drawn * (gain + loss) < loss:
        full = gain == size - mass
        return (size if full else mass + gain), (0.0 if gain == other_mass else other_mass - gain)
    full = loss == other_size - other_mass
    return (0.0 if loss == mass else mass - loss), (other_size if full else other_mass + loss)


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their segment, all settled but at most one a segment, which stays open.

    Only one row waits at a time, so a segment may have any number of rows.
    Large documents come first: the one that stays open is rarely among them.
    """
    held, at = None, 0
    for batch in batches:
        out = []
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            row = list(row)
            if held is not None and held[:2] != row[:2]:
                out.append(held)
                held = None
            at = at + 1 if held is not None else 0
            if held is None:
                held = row
                continue
            held[8], row[8] = transfer(held[4], held[8], row[4], row[8], chance(held[2] + at, row[2]))
            for x in (held, row):
                x[9] = 0 < x[8] < x[4]
            done, held = (row, held) if held[9] else (held, row)
            out.append(done)
            if not held[9]:
                out.append(held)
                held = None
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 10, batch.schema.types, strict=True)], batch.schema.names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(held, batch.schema.types, strict=True)], batch.schema.names)


def n_words(text):
    """How many runs of characters other than blanks a text has; only one letter a word is held, not the words."""
    return F.length(F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w"), " \t\n\x0b\f\r", "")).cast("long")


def source_targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, n_docs, source_size) with sid (1, 2, ... by code point, null last) and target.

    Targets share SHARE of all words by weight; those above MOST times their
    source stop there, and what they leave is shared again, until none is
    above. Each round is one sum over the sources.
    """
    ranked = numbered(sources, [], [F.col("source").asc_nulls_last()], "sid")
    weight = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod(F.col("sid") - 1, F.lit(len(WEIGHTS))).cast("int"))
    ranked = cut(ranked.select("*", weight.alias("weight"), (F.lit(float(MOST)) * F.col("source_size")).alias("cap")), "sources")
    total = SHARE * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        above = F.col("cap") < F.lit(level) * F.col("weight")
        full, left, n = ranked.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        if n == stopped or not left:
            break
        level, stopped = (total - (full or 0.0)) / left, n
    return ranked.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).drop("weight", "cap")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words, repeats counted).

    A null text has size 0 and is never taken; a null source is a source, the
    last one. Null ids are told apart by their text. Rows that repeat are each
    rounded; those alike in id and text are handled one after another. A
    source without words has target 0. An empty table gives an empty result;
    other columns are not read.
    """
    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = cut(one.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("h"), n_words(F.col("text")).alias("size")), "sizes")
    sources = rows.groupBy("source").agg(F.count(F.when(F.col("size") > 0, 1)).alias("n_docs"), F.sum("size").alias("source_size"))
    planned = cut(source_targets(cut(sources, "sources")), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = planned.select(
        F.col("source").alias("named"), "sid", "source_size", "target", F.floor(ratio).alias("copies"), (ratio - F.floor(ratio)).alias("part"),
        F.greatest(F.ceil(F.col("n_docs") / SEGMENT), F.lit(1)).alias("segments"),
    )
    most = planned.agg(F.max("segments")).first()[0] or 1
    mass = F.col("size") * F.col("part")
    level = rows.join(planned, F.col("source").eqNullSafe(F.col("named"))).select(
        "sid", F.pmod(F.xxhash64("h"), "segments").alias("seg"), "h", "doc_id", "size", "source_size", "target", "copies", mass.alias("mass"), ((mass > 0) & (mass < F.col("size"))).alias("open")
    )
    settled = []
    while True:
        level = cut(level, "level")
        settled.append(level.where("not open"))
        fractions = level.where("open")
        dealt = fractions.repartition("sid", "seg").sortWithinPartitions("sid", "seg", F.desc("size"), "h", "doc_id")
        level = dealt.mapInArrow(settle, KIND)
        if most == 1:
            break
        most = -(-most // FAN)
        level = level.withColumn("seg", F.floor(F.col("seg") / FAN))
    # Of each source one document is still open at most: in with the chance it has.
    last = F.when(F.col("open"), F.pmod(F.xxhash64("h", F.lit("last")), F.lit(1 << 53)) / float(1 << 53) * F.col("size") < F.col("mass")).otherwise(F.col("mass") >= F.col("size"))
    settled.append(level.withColumn("mass", F.when(last, F.col("size").cast("double")).otherwise(0.0)))
    out = None
    for part in settled:
        out = part if out is None else out.unionByName(part)
    more = ((F.col("mass") >= F.col("size")) & (F.col("size") > 0)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + more)).alias("taken"))
