"""The bag of little bootstraps against a plain loop, NumPy's bootstrap and itself at other sizes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritable.functions import resampling as R
from veritable.operators import significance as G


def frame(spark, left, right, parts=3):
    rows = [("L", float(x), "e") for x in left] + [("R", float(x), "e") for x in right]
    return spark.createDataFrame(rows, "g string, v double, value string").repartition(parts)


def plain_interval(spark, left, right, resamples, seed, bag_rows):
    """One value, bag and resample at a time; draws by walking up the distribution."""
    m = R.bags(min(len(left), len(right)), bag_rows)
    n = max(R.BAG_RESAMPLES if m > 1 else 1, -(-resamples // m))
    word = (1 << 64) - 1

    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & word
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & word
        return x ^ x >> 31

    sums = np.zeros((2, 2, m, n))
    for side, values in enumerate((left, right)):
        distinct = sorted(set(values))
        hashes = [r[0] & word for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(distinct)], "i int, v double")
                  .orderBy("i").select(F.xxhash64("v")).collect()]
        for v, h in zip(distinct, hashes, strict=True):
            copies = [values.count(v) // m] * m
            for j in range(values.count(v) % m):
                copies[(h % m + j) % m] += 1
            for bag, k in enumerate(copies):
                own = mix(h ^ mix(bag))
                for r in range(n if k else 0):
                    u = (mix((own + 0x9E3779B97F4A7C15 * (r + 1 + seed)) & word) >> 11) / 2.0**53
                    w, p = 0, math.exp(-k * m)
                    acc = p
                    while u >= acc:
                        w += 1
                        p *= k * m / w
                        acc += p
                    sums[side, 0, bag, r] += w
                    sums[side, 1, bag, r] += w * v
    with np.errstate(invalid="ignore", divide="ignore"):
        d = sums[0, 1] / sums[0, 0] - sums[1, 1] / sums[1, 0]
    ends = [np.quantile(x[np.isfinite(x)], [0.025, 0.975]) for x in d if np.isfinite(x).any()]
    return np.mean(ends, axis=0)


@pytest.mark.parametrize(("sizes", "bag_rows"), [((60, 45), 5_000), ((120, 200), 20)])
def test_against_a_plain_loop(spark, sizes, bag_rows, monkeypatch):
    rng = np.random.default_rng(1)
    left, right = rng.normal(10, 4, sizes[0]).round(1).tolist(), rng.normal(9, 3, sizes[1]).round(0).tolist()
    left += [7.0] * 30  # a common value
    monkeypatch.setattr(R, "DRAWS", 3_000)
    df = frame(spark, left, right).select(F.when(F.col("g") == "L", 0).otherwise(1).alias("side"), F.col("v").alias("value"))
    got = R.mean_difference_interval(df, (len(left), len(right)), 200, 0.95, 7, bag_rows).first()
    want = plain_interval(spark, left, right, 200, 7, bag_rows)
    assert tuple(got) == pytest.approx(tuple(want), rel=1e-9)


def test_layout_does_not_matter(spark):
    rng = np.random.default_rng(2)
    left, right = rng.normal(5, 2, 300).tolist(), rng.normal(5, 2, 250).tolist()
    a, b = (G.bootstrap_interval(frame(spark, left, right, n), "g", "v", "L", "R").first() for n in (1, 13))
    assert tuple(a) == pytest.approx(tuple(b), rel=1e-12)


@pytest.mark.parametrize("skewed", [False, True])
def test_many_rows_give_the_interval_of_theory(spark, skewed):
    """40,000 rows are several bags; their interval is that of the normal rule within a tenth of its width."""
    rng = np.random.default_rng(3)
    draw = (lambda n: rng.exponential(3, n)) if skewed else (lambda n: rng.normal(3, 3, n))
    left, right = draw(40_000), draw(60_000)
    assert R.bags(40_000) > 1
    got = G.bootstrap_interval(frame(spark, left, right), "g", "v", "L", "R").first()
    half = 1.96 * math.sqrt(left.var() / len(left) + right.var() / len(right))
    middle = left.mean() - right.mean()
    assert abs(got.boot_low - (middle - half)) < 0.2 * half and abs(got.boot_high - (middle + half)) < 0.2 * half


def test_a_hundred_times_the_rows(spark):
    """The same rows a hundred times: a tenth of the width around the same middle, within a tenth of the width."""
    rng = np.random.default_rng(4)
    left, right = rng.normal(10, 5, 400), rng.normal(9, 5, 500)
    one = frame(spark, left, right)
    many = one.select("g", "v", F.explode(F.sequence(F.lit(1), F.lit(100)))).select("g", "v")
    a, b = (G.bootstrap_interval(df, "g", "v", "L", "R").first() for df in (one, many))
    width = (a.boot_high - a.boot_low) / 10
    assert abs((b.boot_high - b.boot_low) - width) < 0.1 * width
    assert abs((b.boot_high + b.boot_low) / 2 - (left.mean() - right.mean())) < 0.1 * width


def test_plan_multiplies_nothing_and_edges(spark):
    df = frame(spark, [1.0, 2.0], [3.0])
    plan = G.bootstrap_interval(df, "g", "v", "L", "R")._jdf.queryExecution().toString()
    assert "Generate" not in plan and "explode" not in plan
    assert G.bootstrap_interval(df, "g", "v", "L", "none").first() == (None, None)
    same = G.bootstrap_interval(frame(spark, [2.0] * 30, [1.0] * 40), "g", "v", "L", "R").first()
    assert tuple(same) == (1.0, 1.0)


def test_poisson_table():
    rng = np.random.default_rng(5)
    for mean in (1, 7, 400, 1_000_000):
        x = R.poisson(rng.random((1, 50_000)), np.array([mean]))
        assert abs(x.mean() - mean) < 5 * math.sqrt(mean / 50_000) and abs(x.var() / mean - 1) < 0.05
