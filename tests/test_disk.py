"""What a query has on disk while it runs, in tables and shuffle files."""

import os
import threading
import time
from contextlib import suppress

import pytest
from leadloom.functions import tables
from leadloom.operators.entities import resolve_companies, resolve_people
from leadloom.plans.lead_queries import exported_leads, json_export
from pyspark.sql import functions as F


def on_disk(spark):
    """Bytes in the shared folder and in Spark's own ones, together."""
    local = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shared = tables.shared_folder(spark).removeprefix("file://")
    total = 0
    for top in (*local, shared):
        for d, _, files in os.walk(top):
            for f in files:
                with suppress(OSError):  # a file may go meanwhile
                    total += os.path.getsize(f"{d}/{f}")
    return total


@pytest.fixture
def no_broadcast(spark):
    """Tables are joined as large ones are."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, was)


def most_of(spark, query):
    """The most bytes that a query has on disk while it runs, beside what was there."""
    tables.sweep(spark)
    spark._jvm.System.gc()
    time.sleep(2)
    before, peaks, done = on_disk(spark), [0], threading.Event()

    def watch():
        while not done.wait(0.1):
            peaks.append(on_disk(spark))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        query().write.format("noop").mode("overwrite").save()
    finally:
        done.set()
        watcher.join()
    return max(peaks) - before


SIGHTINGS = 30_000


def sightings(spark):
    k = F.col("id")
    return spark.range(SIGHTINGS).select(
        k.cast("string").alias("candidate_id"), F.concat(F.lit("p"), k % 3).alias("provider_id"), F.concat_ws("/", k * 7 % 9000, k % 4).alias("external_id"), F.concat(F.lit("Name "), k * 11 % 700).alias("name"),
        F.when(k % 2 == 0, F.concat(F.lit("s"), k * 13 % 5000, F.lit(".com"))).alias("domain"), F.when(k % 3 == 0, F.concat(F.lit("l"), k * 13 % 5000)).alias("profile_id"), (k * 17 % 1000).cast("string").alias("company_id"), F.lit(None).cast("timestamp").alias("discovered_at"),
    )


def test_resolved_companies_take_little_disk(spark, no_broadcast):
    old = spark.createDataFrame([("c1", "Name 1", "s1.com", [], {})], "company_id string, name string, domain string, aliases array<string>, provider_ids map<string,string>")
    assert most_of(spark, lambda: resolve_companies(sightings(spark), old)) < 300 * SIGHTINGS


def test_resolved_people_take_little_disk(spark, no_broadcast):
    old = spark.createDataFrame([("h1", "Name 1", [], "l1", "1", ["1"], {})], "person_id string, name string, aliases array<string>, profile_id string, company_id string, companies array<string>, provider_ids map<string,string>")
    assert most_of(spark, lambda: resolve_people(sightings(spark), old)) < 400 * SIGHTINGS


@pytest.mark.parametrize("query, most", [(exported_leads, 500), (json_export, 700)])
def test_exports_take_little_disk(spark, no_broadcast, query, most):
    """Bytes a lead; there are 15,000."""
    assert most_of(spark, lambda: query(spark, "/root/testdata/sf0.01")) < most * 15_000


def test_lean_tables_and_numbers(spark):
    """A lean table holds the same rows and leaves the session's settings; its numbers are those of ``numbered``."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    df = spark.range(1000).select(F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("g"), (F.col("id") * 37 % 1000).alias("x"))
    assert sorted(map(tuple, tables.lean_cut(df).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    for group in (["g"], []):
        want = tables.numbered(df, group, [F.col("x").desc()], "n")
        assert sorted(map(str, tables.lean_numbered(df, group, [F.col("x").desc()], "n").collect())) == sorted(map(str, want.collect()))
    assert tables.lean_numbered(df.limit(0), ["g"], [F.col("x")], "n").count() == 0
    assert spark.conf.get(key) == was
