"""Profiles kept per file equal the profile of the whole table, and only new files are read."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from veritable.functions.exprs import nan_to_null
from veritable.operators import profile as P
from veritable.operators.profile_state import ProfileState


def table(spark, low, high):
    i = F.col("id")
    return spark.range(low, high).select(
        i.alias("order_id"), (i % 7).cast("int").alias("qty"), F.when(i % 5 > 0, (i % 11) * 1.5).alias("amount"),
        F.when(i % 9 == 0, float("nan")).otherwise(i / 3).alias("ratio"), (i % 4).cast("decimal(10,2)").alias("price"),
        F.concat(F.lit("c"), (i % 6).cast("string")).alias("customer"), F.when(i % 2 == 0, "yes").otherwise("no").alias("flag"),
        F.date_format(F.date_add(F.lit("2024-01-01"), (i % 300).cast("int")), "yyyy-MM-dd").alias("order_date"),
        F.lit(None).cast("string").alias("nothing"), F.array(i).alias("other"))


def same(state, spark, path):
    whole = nan_to_null(spark.read.parquet(path))
    key = lambda r: r["position"]
    want = sorted((r.asDict() for r in P.profile_dataset(whole).collect()), key=key)
    assert sorted((r.asDict() for r in state.profile().collect()), key=key) == want and len(want) == 9
    numeric = ["order_id", "qty", "amount", "ratio", "price"]
    want = {r.column_name: r.asDict() for r in P.numeric_stats(whole, numeric).collect()}
    got = {r.column_name: r.asDict() for r in state.numeric_stats().collect()}
    assert set(got) == set(want)
    for name, row in got.items():
        assert {k: row[k] for k in row if k != "column_name"} == pytest.approx(
            {k: v for k, v in want[name].items() if k not in ("median", "column_name")}, rel=1e-9, abs=1e-9)


def test_new_changed_and_deleted_files(spark, tmpdir_path):
    path, folder = os.path.join(tmpdir_path, "t a+b%.parquet"), os.path.join(tmpdir_path, "state")
    table(spark, 0, 500).repartition(3).write.parquet(path)
    state = ProfileState(spark, path, folder)
    assert len(state.refresh()) == 3 and state.refresh() == []
    same(state, spark, path)
    old = glob.glob(f"{path}/part-*")
    table(spark, 500, 900).coalesce(1).write.mode("append").parquet(path)
    assert len(state.refresh()) == 1
    same(state, spark, path)
    os.remove(old[0])  # a deleted file no longer counts
    assert state.refresh() == []
    same(state, spark, path)
    table(spark, 5_000, 5_030).coalesce(1).write.mode("append").parquet(path)
    new = next(f for f in glob.glob(f"{path}/part-*") if f not in old and os.path.getsize(f) != os.path.getsize(old[1]))
    os.replace(new, old[1])  # a file with new contents under an old name
    os.remove(os.path.join(path, f".{os.path.basename(old[1])}.crc"))
    same(state, spark, path)


def test_old_files_are_not_opened(spark, tmpdir_path):
    path, folder = os.path.join(tmpdir_path, "t.parquet"), os.path.join(tmpdir_path, "state")
    table(spark, 0, 100).coalesce(1).write.parquet(path)
    schema = "order_id long, qty int, customer string"
    state = ProfileState(spark, path, folder, schema=schema)
    state.refresh()
    first = glob.glob(f"{path}/part-*")[0]
    size, times = os.path.getsize(first), os.stat(first)
    with open(first, "wb") as f:
        f.write(b"x" * size)  # reading it would fail
    os.utime(first, ns=(times.st_atime_ns, times.st_mtime_ns))
    table(spark, 100, 200).coalesce(1).write.mode("append").parquet(path)
    assert len(state.refresh()) == 1
    assert {r.n_rows for r in state.profile().collect()} == {200}


def test_unfinished_refresh_is_not_seen(spark, tmpdir_path, monkeypatch):
    path, folder = os.path.join(tmpdir_path, "t.parquet"), os.path.join(tmpdir_path, "state")
    table(spark, 0, 60).coalesce(2).write.parquet(path)
    state = ProfileState(spark, path, folder)
    with monkeypatch.context() as m:
        m.setattr("veritable.operators.profile_state.moments", lambda hist: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            state.refresh()
    assert os.path.exists(f"{folder}/text") and state._manifest().isEmpty()
    same(state, spark, path)


def test_delimited_files(spark, tmpdir_path):
    path, folder = os.path.join(tmpdir_path, "t.csv"), os.path.join(tmpdir_path, "state")
    spark.range(50).select("id", F.lit("x").alias("s")).write.csv(path)
    state = ProfileState(spark, path, folder, fmt="csv", schema="id long, s string")
    assert {(r.column_name, r.unique_count) for r in state.profile().collect()} == {("id", 50), ("s", 1)}
    spark.range(50, 60).select("id", F.lit("y").alias("s")).write.mode("append").csv(path)
    assert {(r.column_name, r.unique_count) for r in state.profile().collect()} == {("id", 60), ("s", 2)}


def test_cache_sees_changed_files(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "t.parquet")
    spark.range(10).write.parquet(path)
    cache = P.ProfileCache(size=2)
    assert cache.rows(spark.read.parquet(path))[0]["n_rows"] == 10 and cache.rows(spark.read.parquet(path))[0]["n_rows"] == 10
    assert len(cache) == 1
    spark.range(30).write.mode("overwrite").parquet(path)
    assert cache.rows(spark.read.parquet(path))[0]["n_rows"] == 30
    for n in range(4):
        cache.rows(spark.range(n + 1))
    assert len(cache) == 2
