"""Staged runs and their commit; D1: whole rows by fingerprint."""

import os

import pytest
from pyspark.sql import functions as F

from veritable.operators import compare as V
from veritable.operators import duplicates as D


def kpis(spark, value):
    return spark.createDataFrame([("total_revenue", value, "money"), ("records", None, "count")], "kpi_id string, value double, unit string")


def test_a_run_counts_once_it_is_committed(spark, tmpdir_path):
    store = V.RunStore(spark, os.path.join(tmpdir_path, "runs"))
    store.append("r1", "2024-01-01T00:00:00", "fp", 3.0, kpis(spark, 10.0))
    lost = store.stage("r2", "fp", kpis(spark, 99.0))  # the writer dies here
    assert [r.run_id for r in store.runs().collect()] == ["r1"]
    assert {r.run_id for r in store.kpis().collect()} == {"r1"} and store.kpis("fp").count() == 2
    assert store.previous("fp", "r3").first().run_id == "r1"
    store.commit("r2", "2024-02-01T00:00:00", "fp", 3.0, lost)
    assert store.previous("fp", "r3").first().run_id == "r2"
    store.append("r2", "2024-02-02T00:00:00", "fp", 4.0, kpis(spark, 98.0))  # written again
    assert [(r.run_id, r.months) for r in store.list_runs().collect()] == [("r2", 4.0), ("r1", 3.0)]
    assert [r.value for r in store.kpis().where("run_id = 'r2' AND value IS NOT NULL").collect()] == [98.0]


def test_previous_reads_one_folder(spark, tmpdir_path):
    store = V.RunStore(spark, os.path.join(tmpdir_path, "runs"))
    for k in range(4):
        store.append(f"r{k}", f"2024-0{k + 1}-01", f"f{k % 2}", None, kpis(spark, float(k)))
    store.append("empty", "2024-09-01", "f0", None, kpis(spark, None))
    found = store.previous("f0", "r0")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fingerprint" in plan
    assert found.first().run_id == "r2"  # a run without a KPI is none to compare with
    assert store.previous("f0", "r2").first().run_id == "r0" and store.previous("none", "x").first() is None
    with pytest.raises(ValueError):
        store.append("r", "2024", "../x", None, kpis(spark, 1.0))


def frame(spark):
    rows = [(i % 50, f"s{i % 50}", None if i % 50 == 3 else float(i % 50), [i % 50]) for i in range(120)] + [(1_000 + i, "x", None, None) for i in range(300)]
    rows += [(5, "s5", float("nan"), [5]), (5, "s5", float("nan"), [5]), (6, "z", 0.0, None), (6, "z", -0.0, None), (None, None, None, None), (None, None, None, None)]
    return spark.createDataFrame(rows, "a int, b string, c double, _fingerprint array<int>").repartition(5)


def plain(df):
    g = df.groupBy(*df.columns).count().where("count > 1")
    return tuple(g.agg(F.sum(F.col("count") - 1), F.count(F.lit(1)), F.sum("count")).first())


def test_whole_rows(spark):
    df = frame(spark)
    assert tuple(D.find_duplicates(df).first()) == plain(df)
    assert D.duplicate_examples(df, n=1_000).count() == plain(df)[2]


def test_colliding_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(D, "row_fingerprint", lambda columns: F.struct(F.pmod(F.xxhash64(*columns), F.lit(2)).alias("a")))
    df = frame(spark)
    assert tuple(D.find_duplicates(df).first()) == plain(df)
    assert tuple(D.find_duplicates(df.where("a > 1000")).first()) == (0, 0, 0)


def test_wide_rows_are_not_the_first_shuffle_key(spark):
    df = frame(spark)
    plan = D.find_duplicates(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "xxhash64" in plan
