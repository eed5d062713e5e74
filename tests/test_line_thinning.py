"""Thinned line charts (C6) against a plain sort."""

import pytest
from pyspark.sql import functions as F

from veritable.functions import ranking
from veritable.operators import charts as CH


def wanted(xs, m):
    xs = sorted(xs)
    return {xs[k * (len(xs) - 1) // (m - 1)] for k in range(m)}


@pytest.mark.parametrize("cuts", [3, 31, ranking.CUTS])
@pytest.mark.parametrize("kind", ["bigint", "double", "string"])
def test_same_points_as_a_sort(spark, monkeypatch, cuts, kind):
    monkeypatch.setattr(ranking, "CUTS", cuts)
    x = F.pmod(F.col("id") * 7919, F.lit(2003))  # 2,003 points, two rows each
    x = F.pow(x.cast("double"), 3.0) if kind == "double" else x.cast(kind)  # most points crowd at one end
    df = spark.range(4006).select(x.alias("x"), F.lit(1.5).alias("y"))
    got = {r.x: r.y for r in CH.line_table(df, "x", "y", "sum", max_points=50).collect()}
    assert set(got) == wanted({r.x for r in df.collect()}, 50) and len(got) == 50
    assert set(got.values()) == {3.0}


def test_ranks_near_the_ends(spark):
    df = spark.range(1000).withColumnRenamed("id", "x")
    got = {r.x: r["_rank"] for r in ranking.near_ranks(df, "x", [0, 500, 999]).collect()}
    assert {0, 500, 999} <= set(got) and all(x == rank for x, rank in got.items())


def test_points_are_not_sorted_as_a_whole(spark, capsys):
    df = spark.range(50_000).select(F.col("id").alias("x"), F.lit(1.0).alias("y"))
    CH.line_table(df, "x", "y", "sum", max_points=20).explain()
    assert "rangepartitioning" not in capsys.readouterr().out
