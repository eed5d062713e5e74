"""The screen before the join loses no candidate and keeps other columns out of it."""

import pytest
from pyspark.sql import functions as F

from veritable.operators import joining as J


@pytest.fixture(scope="module")
def sides(spark):
    i = F.col("id")
    left = spark.range(6_000).select(
        i.alias("order_id"), (i % 900).alias("customer"), F.concat(F.lit("p"), (i % 2_500).cast("string")).alias("part"),
        (i + 1_000_000).alias("far"), F.concat(F.lit("x"), i.cast("string")).alias("note"), (i % 40).cast("double").alias("store"),
        F.when(i % 3 == 0, i % 7).alias("few"), (i * 2).alias("even"), (i * 3).alias("third"))
    right = spark.range(3_000).select(
        i.alias("customer_id"), F.concat(F.lit("p"), i.cast("string")).alias("part_no"), (i % 45).alias("store"),
        F.concat(F.lit("y"), i.cast("string")).alias("name"), (i * 4).alias("fourth"))
    return left, right


def test_same_candidates_without_the_screen(sides):
    left, right = sides
    lc, rc = left.columns, right.columns
    every = {(r.left_column, r.right_column): r for r in J.candidate_stats(left, lc, right, rc).collect()}
    want = {k: tuple(r) for k, r in every.items() if r.overlap >= J.MIN_OVERLAP}
    got = {(r.left_column, r.right_column): tuple(r) for r in J.candidate_stats(left, lc, right, rc, J.MIN_OVERLAP).collect() if r.overlap >= J.MIN_OVERLAP}
    assert got == want and len(want) >= 6
    screened = {(r.left_column, r.right_column): r for r in J.screen_pairs(J.key_histogram(left, lc), J.key_histogram(right, rc)).collect()}
    assert set(screened) == set(every)
    ruled_out = [k for k, r in screened.items() if not r.kept]
    assert not set(ruled_out) & set(want) and len(ruled_out) >= len(every) - len(want) - 3
    for k, r in screened.items():
        assert every[k].overlap <= r.bound + 1e-12
        assert (r.found, r.sampled) == (min(r.found, J.SAMPLE), min(r.left_distinct, J.SAMPLE))


def test_any_sample_size(sides, monkeypatch):
    left, right = sides
    want = {(r.left_column, r.right_column, r.overlap) for r in J.candidate_stats(left, left.columns, right, right.columns).collect() if r.overlap >= 0.5}
    for size in (3, 60, 100_000):
        monkeypatch.setattr(J, "SAMPLE", size)
        got = J.candidate_stats(left, left.columns, right, right.columns, 0.5).where("overlap >= 0.5").collect()
        assert {(r.left_column, r.right_column, r.overlap) for r in got} == want


def test_pruned_columns_stay_out_of_the_join(spark, sides):
    """Rows that reach the join of the histograms are those of kept columns alone."""
    left, right = sides
    kept = J.screen_pairs(J.key_histogram(left, ["far", "note"]), J.key_histogram(right, ["customer_id", "name"])).where("kept")
    assert kept.isEmpty()
    assert J.candidate_stats(left, ["far", "note"], right, ["customer_id", "name"], 0.5).collect() == []
    found = J.find_candidates(left, right, {}, {}, J.distinct_counts(left, left.columns), J.distinct_counts(right, right.columns)).collect()
    assert ("customer", "customer_id") in {(r.left_column, r.right_column) for r in found} and all(r.overlap >= 0.5 for r in found)
    empty = left.where("false")
    assert J.candidate_stats(empty, ["customer"], right, ["customer_id"], 0.5).collect() == []


def test_sample_numbers_few_keys(spark):
    """Of a column's keys only about twice the sample come to the window that numbers them, in one task a column."""
    left = spark.range(400_000).select(F.col("id").alias("a"))
    screened = J.screen_pairs(J.key_histogram(left, ["a"]), J.key_histogram(left, ["a"]))
    assert [(r.sampled, r.found, r.kept) for r in screened.collect()] == [(J.SAMPLE, J.SAMPLE, True)]
    plan = screened._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window [row_number"):]
    assert "_upto" in below.split("\n")[1] + below.split("\n")[2] + below.split("\n")[3]
