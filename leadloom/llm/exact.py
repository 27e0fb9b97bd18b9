"""Exact deduplication by two passes over a Bloom filter, in DataFrame functions only.

Pass 1 maps each text's hash to two positions of a bounded position space and
counts the hits; positions hit twice are packed into 4 KB bitmaps. The filter
has at most ``2**MAX_BITS`` bits (16 MB), whatever the input, so it may be
broadcast. Pass 2 probes it: only rows whose two positions are both set can
have an equal text, and only those shuffle; all others pass straight through
as groups of one. A full filter costs shuffle, never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text

#: Bits of the filter for each expected row, and the most bits as a power of two.
BITS_PER_ROW, MAX_BITS = 16, 27


def filter_bits(rows: int) -> int:
    """The filter's size: a power of two, 2**15 at least and 2**27 (16 MB) at most."""
    return 1 << min(MAX_BITS, max(15, (max(1, rows) * BITS_PER_ROW - 1).bit_length()))


def positions(digest: Column, bits: int) -> list[Column]:
    """Two independent filter positions of a digest."""
    return [F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(bits)).alias(f"p{k}") for k in (0, 1)]


def repeated_filter(digests: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap): the positions that at least two rows hit. Hits are summed before they shuffle."""
    hits = digests.select(F.explode(F.array(*positions(F.col("sha"), bits))).alias("at"))
    twice = hits.groupBy("at").count().where("count > 1")
    # bitmap_bucket_number counts from 1 and takes 32,768 positions a bucket
    return twice.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bitmap")
    )


def is_set(bitmap: Column, at: Column) -> Column:
    """Whether a bitmap has the bit of a position of its bucket."""
    offset = F.bitmap_bit_position(at + 1)
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(offset, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(offset, F.lit(8)))), F.lit(2)) == 1


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of identical texts the row with the largest id stays. A null text counts
    as empty. A null id never wins over another; in a group of null ids only,
    keep_id is null and every row is kept. Rows that repeat both the kept id
    and its text are each counted and each marked kept, as ids cannot tell
    them apart. An empty table gives an empty result; other columns are not
    read.
    """
    # Texts are read and hashed once; all else goes over ids and hashes.
    rows = cut(id_and_text(docs, id_col, text_col).select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha")), "digests")
    bits = filter_bits(rows.count())
    maps = repeated_filter(rows, bits)
    probed = rows.select("*", *positions(F.col("sha"), bits))
    for k in (0, 1):
        side = F.broadcast(maps.select(F.col("bucket").alias(f"b{k}"), F.col("bitmap").alias(f"m{k}")))
        at = F.col(f"p{k}")
        probed = probed.join(side, F.bitmap_bucket_number(at + 1) == F.col(f"b{k}"), "left").withColumn(
            f"hit{k}", F.coalesce(is_set(F.col(f"m{k}"), at), F.lit(False))
        ).drop(f"b{k}", f"m{k}", f"p{k}")
    probed = probed.withColumn("maybe", F.col("hit0") & F.col("hit1")).drop("hit0", "hit1")

    shown = F.lower(F.hex("sha")).alias("text_sha256")
    alone = probed.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), shown,
    )
    some = probed.where("maybe").select("doc_id", "sha")
    groups = some.groupBy(F.col("sha").alias("key")).agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    # Read back as a table, the groups meet the rows in an ordinary join, whose hot texts adaptive execution splits.
    groups = cut(groups, "groups")
    grouped = some.join(groups, some.sha == groups.key).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), shown
    )
    return alone.unionByName(grouped)
