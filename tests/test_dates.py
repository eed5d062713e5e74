"""R2: the order of day and month is decided by the whole column."""

from datetime import date

from pyspark.sql import functions as F

from veritable.functions.dates import date_orders, time_column
from veritable.operators import cleaning as C
from veritable.operators import kpis as K
from veritable.operators import profile as P


def frame(spark, *values):
    return spark.createDataFrame([(i, v, 1.0) for i, v in enumerate(values)], "i int, d string, v double").repartition(3)


def days(df):
    return [r.t.date() if r.t else None for r in df.select("i", time_column(df, "d").alias("t")).orderBy("i").collect()]


def test_one_value_turns_the_column(spark):
    assert days(frame(spark, "03/04/2024", "31/12/2024")) == [date(2024, 4, 3), date(2024, 12, 31)]
    assert days(frame(spark, "03/04/2024", "12/31/2024")) == [date(2024, 3, 4), date(2024, 12, 31)]
    assert days(frame(spark, "03/04/2024", "1-2-2024 nonsense")) == [date(2024, 3, 4), None]
    assert days(frame(spark, "3-4-2024", " 25/12/24 ", None, "", "2024-05-06")) == [date(2024, 4, 3), date(2024, 12, 25), None, None, date(2024, 5, 6)]


def test_mixed_evidence_takes_the_majority(spark):
    got = days(frame(spark, "03/04/2024", "31/12/2024", "30/12/2024", "12/25/2024"))
    assert got == [date(2024, 4, 3), date(2024, 12, 31), date(2024, 12, 30), date(2024, 12, 25)]
    even = frame(spark, "03/04/2024", "31/12/2024", "12/25/2024")
    assert days(even)[0] == date(2024, 3, 4)
    row = date_orders(even.select("d"), ["d"], dayfirst=True).first()
    assert (row.against_month_first, row.against_day_first, row.day_first) == (1, 1, True)


def test_impossible_parts_say_nothing(spark):
    row = date_orders(frame(spark, "99/01/2024", "13/13/2024", "45/99/24", "1/2/345", "13.01.2024"), ["d"]).first()
    assert (row.against_month_first, row.against_day_first, row.day_first) == (0, 0, False)
    empty = frame(spark, "x").where("false")
    assert not date_orders(empty, ["d"]).first().day_first


def test_operators_follow_the_vote(spark):
    df = frame(spark, "03/04/2024", "31/12/2024")
    assert [r.d.date() for r in C.convert_column(df, "d", "date").orderBy("i").collect()] == [date(2024, 4, 3), date(2024, 12, 31)]
    assert {r.period for r in K.monthly_totals(df, "d", "v").collect()} == {"2024-04", "2024-12"}
    stats = P.datetime_stats(df, ["d"]).first().asDict()
    assert "2024-04-03" in str(list(stats.values()))
    report = C.convert_report(df, "d", "date").first()
    assert (report.blanks_after, report.unreadable) == (0, 0)
    # rows filtered later are read in the order of the whole column
    one = C.convert_column(df, "d", "date").where("i = 0")
    assert one.agg(F.min("d")).first()[0].date() == date(2024, 4, 3)
