from pyspark.sql import functions as F

from tests.test_verification import _simpson
from veritable.operators import confound as X
from veritable.operators import grounding as N
from veritable.operators import profile as P


def test_profile_cache_reuses_until_the_table_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    cache = P.ProfileCache()
    a = cache.rows(df)
    b = cache.rows(df.select("x", "y"))
    assert a == b and len(cache) == 1
    cache.rows(df.filter(F.col("x") > 1))
    assert len(cache) == 2


def test_check_extremes_finds_the_reversal(spark):
    df = _simpson(spark)
    row = X.check_extremes(df, "channel", "revenue", ["region"]).first()
    assert row["kind"] == "reversal"


def test_fact_base_builder(spark):
    tv = spark.createDataFrame([("region", 1, "north", 30), ("region", 2, "south", 10)],
                               "column_name string, rank int, value string, cnt long")
    chart = spark.createDataFrame([("a", 2764183.0), ("b", 100.0)], "g string, v double")
    frame = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    facts = N.build_fact_base(spark, counts=[1224, 14], percentages=[4.2], tables=[chart], top_values=tv,
                              frame=frame, frame_columns=["x"])
    vals = {(round(r["value"], 4), r["is_percentage"]) for r in facts.collect()}
    assert (1224.0, False) in vals and (2800000.0, False) in vals         # 2 significant digits of 2,764,183
    assert (75.0, True) in vals and (200.0, True) in vals                 # share of 30 in 40; change 10 -> 30
    assert (2.0, False) in vals and (4.0, True) in vals                   # frame mean; percentage rounded
