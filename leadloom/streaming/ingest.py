"""Incremental evidence: append what is new, once, and recompute the status of touched entities.

A store is a folder of runs. Each batch appends a run of its own, named by its
epoch, so a replay writes the same run again. Runs of one size are merged FAN at
a time into one that is named by all its epochs, and a run inside the range of
another is no longer read, so there is no moment at which rows are missing or
double: a merge that dies has changed nothing. So files stay few, and a row is
rewritten only as often as the logarithm of the number of batches.

A batch notes its entities before it appends and drops the note once their
status is told. A note that is still there, beside a finished run, is a batch
that died between the two; the next one finishes it first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from ..functions.tables import cut, discard
from ..operators.evidence import ENTITY, field_status, unseen

KEYS = ["entity_type", "entity_id", "field", "provider", "external_id", "retrieved_at"]
#: Runs of one size that are merged.
FAN = 8


def bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` with the bucket of their entity, by which a store is partitioned."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*ENTITY), F.lit(buckets)).cast("int"))


def create_store(spark: SparkSession, store: str, schema: StructType) -> None:
    """An empty store for evidence of the given schema."""
    whole = StructType([*schema.fields]).add("bucket", IntegerType())
    spark.createDataFrame([], whole).write.parquet(f"{store}/schema")


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def _finished(spark: SparkSession, folder: str) -> list[str]:
    """The names of the tables in a folder that were written to their end."""
    fs, where = _at(spark, folder)
    names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
    return [n for n in names if fs.exists(_at(spark, f"{folder}/{n}/_SUCCESS")[1])]


def runs(spark: SparkSession, store: str) -> list[tuple[int, int]]:
    """(first, last) epoch of the runs that count, in order: those that lie in no other."""
    found = sorted(((int(a), int(b)) for a, b in (n.removeprefix("run=").split("-") for n in _finished(spark, f"{store}/runs"))), key=lambda r: (r[0], -r[1]))
    out: list[tuple[int, int]] = []
    for run in found:
        if not out or run[1] > out[-1][1]:
            out.append(run)
    return out


def _run(store: str, first: int, last: int) -> str:
    return f"{store}/runs/run={first}-{last}"


def _read(spark: SparkSession, store: str, which: list[tuple[int, int]]) -> DataFrame:
    schema = spark.read.parquet(f"{store}/schema").schema
    if not which:
        return spark.createDataFrame([], schema)
    named = StructType([*schema.fields]).add("run", StringType())
    return spark.read.option("basePath", f"{store}/runs").schema(named).parquet(*[_run(store, a, b) for a, b in which]).select(*schema.names)


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """All evidence of a store."""
    return _read(spark, store, runs(spark, store)).drop("bucket")


def compact(spark: SparkSession, store: str, before: int) -> None:
    """Merge runs of one size, of epochs before the given one, until fewer than FAN of a size stand beside each other."""
    size = lambda run: len(_digits(run[1] - run[0] + 1))
    while True:
        have = [r for r in runs(spark, store) if r[1] < before]
        starts = (k for k in range(len(have) - FAN + 1) if len({size(r) for r in have[k : k + FAN]}) == 1)
        k = next(starts, None)
        if k is None:
            return
        old = have[k : k + FAN]
        # Small buckets share a file, and a large one is split.
        merged = _read(spark, store, old).hint("rebalance", "bucket")
        merged.write.mode("overwrite").partitionBy("bucket").parquet(_run(store, old[0][0], old[-1][1]))
        for a, b in old:
            _delete(spark, _run(store, a, b))


def _digits(n: int) -> list[int]:
    out = []
    while n:
        out.append(n % FAN)
        n //= FAN
    return out


def _status(stored: DataFrame, new: DataFrame | None, entities: DataFrame) -> DataFrame:
    whole = stored.join(entities, ENTITY, "left_semi")
    return cut(field_status(whole if new is None else whole.unionByName(new)), "status")


def finish(spark: SparkSession, store: str, touched: Callable[[DataFrame, int], None], but: int | None = None) -> None:
    """Tell the status of batches that were appended and died before it was told."""
    have = runs(spark, store)
    for epoch in sorted(map(int, _finished(spark, f"{store}/notes"))):
        if epoch != but and any(a <= epoch <= b for a, b in have):
            note = spark.read.parquet(f"{store}/notes/{epoch}")
            hit = [r.bucket for r in note.select("bucket").distinct().collect()]
            status = _status(_read(spark, store, have).where(F.col("bucket").isin(hit)), None, note.select(*ENTITY).distinct())
            touched(status, epoch)
            _delete(spark, f"{store}/notes/{epoch}")
            discard(status)


def ingest_batch(store: str, touched: Callable[[DataFrame, int], None], buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over the store at ``store``; ``touched`` gets the new status rows, at least once an epoch.

    The store is partitioned by bucket of entity, and a batch reads only the
    buckets that its entities are in, once. A batch that is replayed adds
    nothing, as the anti join has no time bound, and gives the same status.
    Null entity ids are left out of the status, as nobody can ask for them.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        finish(spark, store, touched, but=epoch)
        rows = cut(bucketed(batch, buckets), "batch")
        hit = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        have = [r for r in runs(spark, store) if r != (epoch, epoch)]
        stored = _read(spark, store, have).where(F.col("bucket").isin(hit))
        new = cut(unseen(rows, stored, [*KEYS, "bucket"]), "new")
        entities = rows.select(*ENTITY, "bucket").distinct()
        entities.write.mode("overwrite").parquet(f"{store}/notes/{epoch}")
        new.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(_run(store, epoch, epoch))
        status = _status(stored, new, entities.drop("bucket"))
        touched(status, epoch)
        _delete(spark, f"{store}/notes/{epoch}")
        compact(spark, store, epoch)
        for table in (rows, new, status):
            discard(table)

    return run
