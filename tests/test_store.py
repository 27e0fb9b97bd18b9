import datetime as dt
from pathlib import Path

import pytest
from leadloom.streaming import ingest as N

KIND = "entity_type string, entity_id string, field string, key string, provider string, external_id string, confidence string, retrieved_at timestamp, id string"


def row(entity, key, k):
    return ("COMPANY", entity, "industry", key, "p", f"x{k}", "LOW", dt.datetime(2024, 1, 1), str(k))


class Told(dict):
    """Status by epoch and entity; dies where it is told to."""

    def __init__(self, dies=()):
        self.dies = set(dies)

    def __call__(self, status, epoch):
        if epoch in self.dies:
            raise RuntimeError("lost")
        self[epoch] = {r.entity_id: r.status for r in status.collect()}


def test_a_batch_that_dies_after_its_append_is_finished_by_the_next(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    df = lambda *rows: spark.createDataFrame(rows, KIND)
    N.create_store(spark, store, df(row("a", "x", 0)).schema)
    told = Told(dies={1})
    run = N.ingest_batch(store, told, buckets=4)
    run(df(row("a", "x", 0), row("b", "x", 1)), 0)
    with pytest.raises(RuntimeError, match="lost"):
        run(df(row("a", "y", 2)), 1)
    assert N.read_store(spark, store).count() == 3 and 1 not in told
    told.dies.clear()
    run(df(row("c", "x", 3)), 2)
    assert told == {0: {"a": "INSUFFICIENT", "b": "INSUFFICIENT"}, 1: {"a": "CONFLICT"}, 2: {"c": "INSUFFICIENT"}}
    assert not list(Path(f"{tmp_path}/store/notes").glob("*"))


def test_a_replayed_epoch_writes_its_run_again(spark, tmp_path, monkeypatch):
    """Before the append, after it, and as a whole."""
    store = f"file://{tmp_path}/store"
    df = lambda *rows: spark.createDataFrame(rows, KIND)
    N.create_store(spark, store, df(row("a", "x", 0)).schema)
    told = Told()
    run = N.ingest_batch(store, told, buckets=4)
    with monkeypatch.context() as m:
        m.setattr(N, "_status", lambda *x: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run(df(row("a", "x", 0)), 0)
    for _ in range(2):
        run(df(row("a", "x", 0)), 0)
    assert N.read_store(spark, store).count() == 1 and told == {0: {"a": "INSUFFICIENT"}}
    run(df(row("a", "x", 0), row("a", "z", 1)), 1)
    assert N.read_store(spark, store).count() == 2 and told[1] == {"a": "CONFLICT"}


def test_files_stay_few_and_a_merge_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "FAN", 3)
    store = f"file://{tmp_path}/store"
    df = lambda *rows: spark.createDataFrame(rows, KIND).coalesce(1)
    N.create_store(spark, store, df(row("a", "x", 0)).schema)
    told = Told()
    run = N.ingest_batch(store, told, buckets=2)
    for k in range(12):
        run(df(row(f"e{k % 4}", "x" if k < 8 else "y", k)), k)
        have = N.runs(spark, store)
        assert len(have) <= 6 and [e for a, b in have for e in range(a, b + 1)] == list(range(k + 1))
    assert N.read_store(spark, store).count() == 12
    assert len(list(Path(f"{tmp_path}/store/runs").glob("*/bucket=*/*.parquet"))) <= 2 * len(have)
    assert told[4] == {"e0": "SUPPORTED"} and told[8] == {"e0": "CONFLICT"}
    # A merged run beside those it came from, and one that was not finished.
    whole = N._read(spark, store, have)
    whole.write.partitionBy("bucket").parquet(N._run(store, 0, 11))
    assert N.runs(spark, store) == [(0, 11)] and N.read_store(spark, store).count() == 12
    whole.write.partitionBy("bucket").parquet(N._run(store, 0, 99))
    Path(f"{tmp_path}/store/runs/run=0-99/_SUCCESS").unlink()
    assert N.runs(spark, store) == [(0, 11)]
