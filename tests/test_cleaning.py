from pyspark.sql import functions as F

from veritable.operators import cleaning as C
from veritable.operators import duplicates as D
from veritable.operators import outliers as O
from veritable.sources.readers import tidy


def _messy(spark):
    rows = [("INV-1", "2024-01-01", "Ann", "Books", 100.0, 60.0), ("INV-2", "2024-01-02", "Bob", "Toys", None, 30.0),
            ("INV-1", "2024-01-01", "Ann", "Books", 100.0, 60.0), ("INV-3", "2024-01-03", "Cy", "Books", 9999.0, 10.0),
            ("INV-4", "2024-01-04", None, "Games", 80.0, 40.0), ("INV-5", "2024-01-05", "Dee", "Toys", 90.0, 45.0)]
    return spark.createDataFrame(rows, "invoice_id string, sale_date string, customer_name string, "
                                       "product_category string, revenue double, cost double")


def test_duplicates_found_and_dropped(spark):
    df = _messy(spark)
    rep = D.find_duplicates(df).first()
    assert rep["extra_copies"] == 1 and rep["repeated_groups"] == 1
    assert D.drop_duplicates(df).count() == 5


def test_merge_keeps_totals(spark):
    df = _messy(spark)
    merged = D.merge_duplicates(df, ["revenue", "cost"], ["invoice_id"], order_by=["sale_date"])
    before = df.agg(F.sum("revenue"), F.sum("cost")).first()
    after = merged.agg(F.sum("revenue"), F.sum("cost")).first()
    assert merged.count() == 5 and tuple(before) == tuple(after)


def test_keep_first_uses_explicit_order(spark):
    df = spark.createDataFrame([("k", 3, "c"), ("k", 1, "a"), ("k", 2, "b")], "k string, o int, v string")
    assert D.drop_duplicates(df, ["k"], order_by=["o"]).first()["v"] == "a"


def test_outliers_cap_keeps_rows_and_flag_partitions(spark):
    vals = [(float(i),) for i in range(1, 41)] + [(1000.0,), (None,)]
    df = spark.createDataFrame(vals, "x double")
    b = O.outlier_bounds(df, ["x"])
    row = b.first()
    assert row["eligible"] and row["high_count"] == 1
    capped = O.cap_outliers(df, b, "x")
    assert capped.count() == df.count() and capped.filter(F.col("x").isNull()).count() == 1
    flagged = O.flag_outliers(df, b, "x")
    kept = O.remove_outliers(df, b, "x")
    assert kept.count() + flagged.filter("x_is_unusual").count() == df.count()


def test_fill_strategies(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, None), (3.0, "b"), (5.0, "b"), (None, "a")], "v double, c string")
    med = C.fill_missing(df, "v", "median").agg(F.sum("v")).first()[0]
    assert med == 1 + 3 + 5 + 3 + 3
    # mode ties -> smallest value, as pandas
    assert C.fill_missing(df, "c", "mode").filter(F.col("c") == "a").count() == 3
    assert C.fill_missing(df, "c", "").filter(F.col("c") == "Unknown").count() == 1


def test_convert_and_filter(spark):
    df = spark.createDataFrame([("$1,200.50",), ("n/a",), (None,), ("Cancelled",)], "t string")
    conv = C.convert_report(df, "t", "number").first()
    assert conv["unreadable"] == 2
    kept = C.filter_rows(df, "t", ["CANCELLED"])
    assert kept.count() == 3          # the NULL stays


def test_tidy_names(spark):
    df = spark.createDataFrame([(1, 2, None, 4), (None, None, None, None)], "a int, b int, c int, d int").toDF("x", " ", "e", "x")
    t = tidy(df)
    assert t.columns == ["x", "column_2", "x_1"] and t.count() == 1
