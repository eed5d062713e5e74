import numpy as np
import pytest
from pyspark.sql import functions as F

from veritable.operators import attribution as T
from veritable.operators import confound as X
from veritable.operators import joining as J
from veritable.operators import significance as G


def _two_groups(spark, left_mean, right_mean, spread, n, seed=7):
    rng = np.random.default_rng(seed)
    rows = [(i, "L", float(v)) for i, v in enumerate(rng.normal(left_mean, spread, n))]
    rows += [(n + i, "R", float(v)) for i, v in enumerate(rng.normal(right_mean, spread, n))]
    return spark.createDataFrame(rows, "id long, g string, v double")


@pytest.mark.parametrize("params,expected", [
    ((160, 100, 10, 200), {"solid"}),
    ((101, 100, 40, 200), {"noise"}),
    ((1000, 100, 10, 8), {"too_few"}),
    ((150, 100, 90, 60), {"weak", "noise", "solid"}),
    ((100.5, 100, 1, 5000), {"noise"}),
])
def test_verdict_classes(spark, params, expected):
    df = _two_groups(spark, *params)
    row = G.compare_groups(df, "g", "v", "L", "R").first()
    assert row["verdict"] in expected


def test_bootstrap_is_stable_and_close_to_numpy(spark):
    df = _two_groups(spark, 150, 100, 90, 60, seed=3)
    a = G.bootstrap_interval(df, "g", "v", "L", "R").first()
    b = G.bootstrap_interval(df, "g", "v", "L", "R").first()
    assert tuple(a) == tuple(b)
    pdf = df.toPandas()
    lv, rv = pdf[pdf.g == "L"].v.to_numpy(), pdf[pdf.g == "R"].v.to_numpy()
    rng = np.random.default_rng(12345)
    diffs = [rng.choice(lv, len(lv)).mean() - rng.choice(rv, len(rv)).mean() for _ in range(2000)]
    lo, hi = np.quantile(diffs, [0.025, 0.975])
    width = hi - lo
    assert abs(a["boot_low"] - lo) < 0.15 * width and abs(a["boot_high"] - hi) < 0.15 * width


def test_wilson_interval_bounds(spark):
    df = spark.createDataFrame([("a", True)] * 10 + [("b", False)] * 10, "g string, f boolean")
    s = {r["group"]: r for r in G.share_by_group(df, "g", F.col("f")).collect()}
    assert s["a"]["high"] == 1.0 and s["b"]["low"] == 0.0 and 0 < s["a"]["low"] < 1


def _simpson(spark):
    rows = []
    # channel A: 400 rows in Cairo (base 100), 40 in Aswan (base 500); B the other way round; A is +40 within each region
    for i in range(400):
        rows.append(("A", "Cairo", 140.0 + (i % 5)))
    for i in range(40):
        rows.append(("A", "Aswan", 540.0 + (i % 5)))
    for i in range(40):
        rows.append(("B", "Cairo", 100.0 + (i % 5)))
    for i in range(400):
        rows.append(("B", "Aswan", 500.0 + (i % 5)))
    return spark.createDataFrame(rows, "channel string, region string, revenue double")


def test_within_plus_mix_is_the_gap_and_simpson_reverses(spark):
    df = _simpson(spark)
    cells = X.cell_means(df, "channel", "revenue", ["region"], "A", "B")
    d = X.decompose(cells, "A", "B").first()
    assert d["within_difference"] + d["mix_difference"] == pytest.approx(d["overall_difference"], abs=1e-9)
    assert d["overall_difference"] < 0 < d["within_difference"]
    best = X.check(df, "channel", "revenue", "A", "B", ["region"]).first()
    assert best["kind"] == "reversal"


def test_clean_comparison_has_no_confound(spark):
    rng = np.random.default_rng(1)
    rows = [("a" if i % 2 else "b", "x" if rng.random() < 0.5 else "y", float(rng.normal(200 if i % 2 else 100, 10)))
            for i in range(600)]
    df = spark.createDataFrame(rows, "g string, other string, v double")
    assert X.check(df, "g", "v", "a", "b", ["other"]).count() == 0


def test_attribution_contributions_sum_exactly(spark):
    rng = np.random.default_rng(5)
    rows = []
    for m in range(1, 7):
        for i in range(60):
            region = ["north", "south", "east", None][i % 4]
            boost = 3.0 if (m == 4 and region == "north") else 1.0
            rows.append((f"2024-{m:02d}-10", region, f"c{i % 9}", float(rng.uniform(10, 20) * boost)))
    df = spark.createDataFrame(rows, "day string, region string, channel string, revenue double") \
        .withColumn("day", F.to_timestamp("day"))
    summary, contrib = T.explain(df, "day", "revenue", ["region", "channel"])
    s = summary.first()
    assert s["period"] == "2024-04"
    for dim in ("region", "channel"):
        total = contrib.filter(F.col("dimension") == dim).agg(F.sum("change")).first()[0]
        assert total == pytest.approx(s["change"], rel=1e-9)
    labels = {r["label"] for r in contrib.filter(F.col("dimension") == "region").collect()}
    assert "north" in labels
    ranked = T.rank_dimensions(contrib).first()
    assert ranked["dimension"] == "region"


def test_fanout_estimate_equals_join_rows(spark):
    sales = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, None), (5, "A")], "id int, cat string")
    lookup = spark.createDataFrame([("A", "s1"), ("A", "s2"), ("B", "s3")], "cat string, supplier string")
    est = J.value_overlap(sales, "cat", lookup, "cat").first()
    joined = J.apply_join(sales, lookup, "cat", "cat")
    assert est["expected_rows"] == joined.count() == 7
    assert not est["right_unique"]
