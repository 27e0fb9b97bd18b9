"""Tables that cut lineage, in the folder that driver and executors share, and positions within groups."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    On a cluster it must be set. A local session, whose driver is its only
    executor, gets a folder of its own where none is.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def application_folder(spark: SparkSession) -> str:
    """Where this application keeps its tables; nothing reads them once its results are written."""
    return f"{shared_folder(spark)}/leadloom/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Lineage ends there, so a lost executor costs at most the tasks since the
    last cut, and the table's size is known to the optimizer.
    """
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _paths[back] = path
    return back


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Within it Spark deletes the shuffle files of a written DataFrame once it is written, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def lean_cut(df: DataFrame, name: str = "part") -> DataFrame:
    """As :func:`cut`, for little disk: written denser, and the shuffle files behind it go at once."""
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _paths[back] = path
    return back


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` that no plan reads any more."""
    _delete(df.sparkSession, _paths.pop(df))


def sweep(spark: SparkSession) -> None:
    """Delete all tables of this application, once every result that reads them is written."""
    _delete(spark, application_folder(spark))


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: 1..n in each group, by ``order``, which should leave no ties.

    Rows are dealt by ranges of (group, order), so that a group of a third of
    all rows spreads over a third of the tasks; each range counts its own rows,
    and the counts of the ranges before it, one number a range, are added.
    """
    spread = rows.repartitionByRange(*[F.col(g) for g in group], *order)
    parted = cut(spread.withColumn("__range", F.spark_partition_id()), "ranges")
    own = F.row_number().over(Window.partitionBy(*group, "__range").orderBy(*order))
    counts = parted.groupBy(*group, "__range").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    same = F.col("__range") == F.col("__r")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    made = parted.withColumn("__own", own).join(before, same, "left")
    return made.withColumn(name, F.col("__own") + F.col("__before")).select(*rows.columns, name)


def lean_numbered(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """As :func:`numbered`, for little disk: rows are numbered as they are written, sorted in their range, so they shuffle once only."""
    c = F.col
    keys = [c(g) for g in group]
    spread = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    parted = lean_cut(spread.withColumn("__at", F.monotonically_increasing_id()), "ranges")
    dealt = F.shiftright("__at", 33)  # the partition's number, above that of the row
    counts = parted.groupBy(*group, dealt.alias("__range")).agg(F.count("*").alias("__n"), F.min("__at").alias("__least"))
    upto = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[c(g).alias(f"__{g}") for g in group], c("__range").alias("__r"), (F.coalesce(F.sum("__n").over(upto), F.lit(0)) - c("__least") + 1).alias("__before"))
    same = dealt == c("__r")
    for g in group:
        same = same & c(g).eqNullSafe(c(f"__{g}"))
    return parted.join(lean_cut(before, "before"), same, "left").withColumn(name, c("__at") + c("__before")).select(*rows.columns, name)


def before_target(rows: DataFrame, group: list[str], order: list[Column], counted: Column, target: int) -> DataFrame:
    """The rows of each group, by ``order``, before which fewer than ``target`` rows are ``counted``.

    As for :func:`numbered`, rows are dealt by ranges of (group, order), and a
    range knows what the ranges before it count, one number each. Ranges that
    begin beyond the target are left out unread; only those before it are
    counted row by row, so no task ever walks through a whole group.
    """
    c = F.col
    parted = cut(rows.withColumn("__c", F.coalesce(counted.cast("int"), F.lit(0))).repartitionByRange(*[c(g) for g in group], *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = parted.groupBy(*group, "__range").agg(F.sum("__c").alias("__n"))
    upto = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.select(*[c(g).alias(f"__{g}") for g in group], c("__range").alias("__r"), F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__begun")).where(c("__begun") < target)
    same = c("__range") == c("__r")
    for g in group:
        same = same & c(g).eqNullSafe(c(f"__{g}"))
    own = Window.partitionBy(*group, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = parted.join(begun, same).withColumn("__own", F.coalesce(F.sum("__c").over(own), F.lit(0)))
    return near.where(c("__begun") + c("__own") < target).select(*rows.columns)
