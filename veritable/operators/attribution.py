"""Why did it move: exact attribution of a change to its contributors.

Two jobs. The first totals the measure per period (bounded by the calendar).
The second unpivots every dimension to (dimension, level) and computes, in one
conditional aggregation, each level's total inside the chosen period and its
scaled total over the other periods. Breakdown, folding and ranking then work
on that small (dimension x level) table. Contributions of a dimension always
add up to the change exactly: the tail is folded into one row, never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritable.functions.exprs import num, period_bucket, period_key, period_label, stems_from, with_scalars
from veritable.functions.dates import time_column
from veritable.operators.profile import few_valued, profile_dataset

# Fixed values of the attribution rules.
MIN_CONTRIBUTION = 0.03
TOP_CONTRIBUTORS = 5
MAX_DIMENSION_VALUES = 40
MIN_PERIODS = 3
NOT_RECORDED = "not recorded"
CALENDAR_DERIVED = ("_period", "year", "month", "month_name", "quarter", "week", "day", "day_of_week",
                    "day_of_month", "is_weekend", "weekday")
UNUSUAL_SUFFIX = "_is_unusual"


def dimension_rows(profile: DataFrame, measure: str, calendar: bool = True, exclude: tuple[str, ...] = (),
                   max_values: int = MAX_DIMENSION_VALUES) -> DataFrame:
    """T4 as a selection from profile rows (position, column_name, role, unique_count), in table order.

    Dimensions hold labels with 2 to ``max_values`` values; markers, the
    measure and what is built on it, and (unless ``calendar``) calendar parts
    are none.
    """
    name, low = F.col("column_name"), F.lower("column_name")
    barred = name.isin(measure, *exclude) | low.endswith(UNUSUAL_SUFFIX) | stems_from(name, measure)
    if not calendar:
        barred = barred | low.isin(*CALENDAR_DERIVED)
    labels = F.col("role").isin("category", "boolean", "text") & F.col("unique_count").between(2, max_values)
    return profile.where(labels & ~barred).orderBy("position").select("column_name")


def choose_dimensions(df: DataFrame, measure: str, roles: dict[str, str] | None = None, **rules) -> list[str]:
    """T4 on a table (one row per column is read)."""
    few = few_valued(df, rules.get("max_values", MAX_DIMENSION_VALUES))  # only these are profiled
    if not few:
        return []
    return [r["column_name"] for r in dimension_rows(profile_dataset(df.select(*few), roles), measure, **rules).collect()]


def period_totals(df: DataFrame, date: str, measure: str, grain: str = "month") -> DataFrame:
    p = period_bucket(time_column(df, date), grain)       # grouped as a date, labelled after
    return (df.select(p.alias("_p"), num(measure).alias("_v")).filter(F.col("_p").isNotNull())
            .groupBy("_p").agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("total"))
            .select(period_label(F.col("_p"), grain).alias("period"), "total"))


def pick_period(totals: DataFrame) -> DataFrame:
    """One row: the period furthest from the mean (earliest on ties), its
    value, the mean of the other periods and the period count."""
    stats = totals.agg(F.avg("total").alias("_mean"), F.count(F.lit(1)).alias("periods"),
                       F.sum("total").alias("_sum"))
    j = with_scalars(totals, stats)
    best = j.agg(F.min_by(F.struct("period", "total", "_mean", "periods", "_sum"),
                          F.struct(-F.abs(F.col("total") - F.col("_mean")), F.col("period"))).alias("b"))
    return best.select(
        F.col("b.period").alias("period"), F.col("b.total").alias("period_value"),
        ((F.col("b._sum") - F.col("b.total")) / (F.col("b.periods") - 1)).alias("baseline_value"),
        F.col("b.periods").alias("periods"),
    )


def _level_table(df: DataFrame, dims: list[str], measure: str, side_after: Column, side_before: Column,
                 before_scale: Column) -> DataFrame:
    """(dimension, level, after, before) for every dimension in one job."""
    x = F.coalesce(num(measure), F.lit(0.0))
    base = df.select(side_after.alias("_a"), side_before.alias("_b"), x.alias("_v"),
                     (x * before_scale).alias("_sv"),
                     *[F.coalesce(F.col(d).cast("string"), F.lit(NOT_RECORDED)).alias(d) for d in dims])
    base = base.filter(F.col("_a") | F.col("_b"))
    long = base.unpivot(["_a", "_b", "_v", "_sv"], dims, "dimension", "level")
    return long.groupBy("dimension", "level").agg(
        F.sum(F.when(F.col("_a"), F.col("_v")).otherwise(0.0)).alias("after"),
        F.sum(F.when(F.col("_b"), F.col("_sv")).otherwise(0.0)).alias("before"),
    )


def breakdown(levels: DataFrame, change: Column) -> DataFrame:
    """Per dimension, levels by |change| (label on ties), keep those with
    |share| >= 3% (at most 5), fold the rest into one exact row.

    ``levels`` carries (dimension, level, after, before) plus a ``_change``
    column holding the total movement. Returns dimension, position, label,
    change, share, before, after, concentration.
    """
    lv = levels.withColumn("_total", change)
    per_dim = W.partitionBy("dimension")
    lv = lv.withColumn("_nlevels", F.count(F.lit(1)).over(per_dim)).filter(F.col("_nlevels") >= 2)
    lv = lv.withColumn("change", F.col("after") - F.col("before")).filter(F.col("change") != 0)
    lv = lv.withColumn("share", F.col("change") / F.col("_total"))
    order = W.partitionBy("dimension").orderBy(F.abs("change").desc(), F.col("level"))
    big = F.abs("share") >= MIN_CONTRIBUTION
    lv = lv.withColumn("_bigrank", F.sum(F.when(big, 1).otherwise(0)).over(
        order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    kept_flag = big & (F.col("_bigrank") <= TOP_CONTRIBUTORS)
    lv = lv.withColumn("_kept", kept_flag)
    kept = lv.filter("_kept").select("dimension", F.col("_bigrank").alias("position"), F.col("level").alias("label"),
                                      "change", "share", "before", "after")
    rest = lv.filter(~F.col("_kept")).groupBy("dimension").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("change").alias("change"), F.first("_total").alias("_total"),
        F.sum("before").alias("before"), F.sum("after").alias("after"))
    folded = rest.select("dimension", F.lit(TOP_CONTRIBUTORS + 1).alias("position"),
                         F.concat(F.lit("everything else ("), F.col("_n").cast("string"), F.lit(" groups)")).alias("label"),
                         "change", (F.col("change") / F.col("_total")).alias("share"), "before", "after")
    rows = kept.unionByName(folded)
    conc = kept.groupBy("dimension").agg(F.max(F.abs("share")).alias("concentration"))
    dims = rows.select("dimension").distinct()
    conc = dims.join(conc, "dimension", "left").select("dimension", F.coalesce("concentration", F.lit(0.0)).alias("concentration"))
    return rows.join(conc, "dimension")


def explain(df: DataFrame, date: str, measure: str, dims: list[str], period: str | None = None,
            grain: str = "month") -> tuple[DataFrame, DataFrame]:
    """Why one period differs from the mean of the others.

    Returns (summary, contributions). ``summary`` has period, period_value,
    baseline_value, change; it is empty with fewer than 3 periods.
    """
    totals = period_totals(df, date, measure, grain)
    if period is None:
        chosen = pick_period(totals)
    else:
        stats = totals.agg(F.count(F.lit(1)).alias("periods"), F.sum("total").alias("_sum"))
        chosen = with_scalars(totals.filter(F.col("period") == period), stats).select(
            "period", F.col("total").alias("period_value"),
            ((F.col("_sum") - F.col("total")) / (F.col("periods") - 1)).alias("baseline_value"), "periods")
    chosen = chosen.filter(F.col("periods") >= MIN_PERIODS)
    summary = chosen.select("period", "period_value", "baseline_value",
                            (F.col("period_value") - F.col("baseline_value")).alias("change"), "periods")
    summary = summary.filter(F.col("change") != 0)
    p = period_key(time_column(df, date), grain)
    # no chosen period (summary empty) leaves _chosen NULL and no rows
    joined = with_scalars(df.select("*", p.alias("_period")).filter(F.col("_period").isNotNull()),
                          summary.select(F.col("period").alias("_chosen"), F.col("periods").alias("_np"),
                                         F.col("change").alias("_change"))).filter(F.col("_chosen").isNotNull())
    levels = _level_table(joined, dims, measure, F.col("_period") == F.col("_chosen"),
                          F.col("_period") != F.col("_chosen"), F.lit(1.0) / (F.col("_np") - 1))
    levels = with_scalars(levels, summary.select(F.col("change").alias("_change"))).filter(F.col("_change").isNotNull())
    return summary, breakdown(levels, F.col("_change"))


def explain_group_gap(df: DataFrame, group: str, measure: str, left: str, right: str,
                      dims: list[str]) -> tuple[DataFrame, DataFrame]:
    """The same decomposition between two groups' totals."""
    g = F.col(group).cast("string")
    x = num(measure)
    totals = df.agg(F.coalesce(F.sum(F.when(g == left, x)), F.lit(0.0)).alias("left_value"),
                    F.coalesce(F.sum(F.when(g == right, x)), F.lit(0.0)).alias("right_value"),
                    F.count_if(g == left).alias("_nl"), F.count_if(g == right).alias("_nr"))
    summary = totals.filter((F.col("_nl") > 0) & (F.col("_nr") > 0)).select(
        F.lit(left).alias("left"), F.lit(right).alias("right"), "left_value", "right_value",
        (F.col("left_value") - F.col("right_value")).alias("change")).filter(F.col("change") != 0)
    dims = [d for d in dims if d != group]
    levels = _level_table(df, dims, measure, F.coalesce(g == left, F.lit(False)),
                          F.coalesce(g == right, F.lit(False)), F.lit(1.0))
    levels = with_scalars(levels, summary.select(F.col("change").alias("_change"))).filter(F.col("_change").isNotNull())
    return summary, breakdown(levels, F.col("_change"))


def rank_dimensions(contributions: DataFrame) -> DataFrame:
    """T5: dimensions by concentration (largest named share), best first."""
    return (contributions.select("dimension", "concentration").distinct()
            .orderBy(F.col("concentration").desc(), "dimension"))
