"""The rollup stream: repeated and late rows, calls that go on, and batches that die half-way."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidalgrid.streaming import rollup as R

T0 = dt.datetime(2024, 1, 1)


def put(spark, folder, ids, shift=0):
    """One file: a row each id, its time set by the id and ``shift`` hours."""
    rows = [(i, T0 + dt.timedelta(hours=(0 if i is None else i) % 30 + shift), "ab"[(i or 0) % 2]) for i in ids]
    spark.createDataFrame(rows, "id bigint, at timestamp, kind string").coalesce(1).write.mode("append").parquet(folder)


def read(spark, folder):
    return spark.readStream.schema("id bigint, at timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(folder)


def counts(df):
    return {(r.window_start, r.kind): r.n for r in df.collect()}


def expected(ids):
    out = {}
    for i in ids:
        k = (T0 + dt.timedelta(hours=(0 if i is None else i) % 30), "ab"[(i or 0) % 2])
        out[k] = out.get(k, 0) + 1
    return out


def test_calls_go_on_where_the_last_stopped(spark, tmp_path):
    folder, store = f"{tmp_path}/in", f"{tmp_path}/store"
    run = lambda: counts(R.run_rollup(read(spark, folder), "id", "at", "kind", store=store, buckets=4, merge_every=3))
    seen = []
    for k in range(8):
        ids = [*range(20 * k, 20 * k + 30), 0]
        put(spark, folder, ids, shift=0 if k == 0 else 40)  # what repeats comes later, with another time
        put(spark, folder, ids)
        seen = sorted({*seen, *ids})
        if k % 3 == 1:
            got = run()
            assert sum(got.values()) == len(seen)
    got = run()
    assert sum(got.values()) == len(seen) and run() == got
    rows = R.FirstRows(spark, f"{store}/rows", "id bigint, at timestamp, kind string", "id", 4, 3)
    assert rows._written("base")[-1] >= 12 and len(rows._written("batch")) < 8  # old folders are merged and gone
    assert rows.all().select("id").distinct().count() == rows.all().count() == len(seen)


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_batch_that_dies_is_repeated(spark, tmp_path, monkeypatch, when):
    folder, store = f"{tmp_path}/in", f"{tmp_path}/store"
    for k in range(5):
        put(spark, folder, [*range(10 * k, 10 * k + 15), None])
    real, calls = R.FirstRows.add, []

    def dies(self, rows, n):
        if n == 3 and when == "before":
            raise OSError("lost")
        real(self, rows, n)
        calls.append(n)
        if n == 3:
            raise OSError("lost")

    monkeypatch.setattr(R.FirstRows, "add", dies)
    go = lambda: R.run_rollup(read(spark, folder), "id", "at", "kind", store=store, buckets=4, merge_every=2)
    with pytest.raises(Exception, match="lost"):
        go()
    monkeypatch.setattr(R.FirstRows, "add", lambda self, rows, n: (real(self, rows, n), calls.append(n))[0])
    got = counts(go())
    assert got == expected([*range(55), None]) and calls[-2:] == [3, 4] and calls[:3] == [0, 1, 2]


def test_nothing_to_read(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [])
    assert R.run_rollup(read(spark, f"{tmp_path}/in"), "id", "at", "kind").where(F.col("n") > 0).collect() == []
