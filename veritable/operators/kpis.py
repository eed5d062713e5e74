"""KPIs (K1-K15).

All scalar KPIs are fused into one aggregation; the entity KPIs share one
grouped aggregate; the monthly KPIs share one month-total aggregate. Month
totals are bounded by the calendar span (a few hundred rows for decades of
data), which is what makes a window over them a safe single-partition step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritable.functions.exprs import num, period_bucket, period_label
from veritable.functions.dates import time_column
from veritable.functions.quantiles import quantile_literal
from veritable.functions.ranking import sum_of_top

# Fixed values of the KPI rules.
SKEW_NOTE_RATIO = 1.15
MIN_ENTITIES_ACTIVE = 2
MIN_ENTITIES_REPEAT = 5
MIN_MONTHS_GROWTH = 4
MIN_MONTHS_PEAK = 3
MIN_ENTITIES_CONCENTRATION = 10
TOP_SHARE = 0.1

KPI_SCHEMA = "kpi_id string, value double, label string, unit string"


@dataclass
class KpiColumns:
    revenue: str | None = None     # primary measure
    profit: str | None = None
    quantity: str | None = None
    entity: str | None = None      # customer-like column
    date: str | None = None
    money_scale: int | None = None  # sum money exactly as decimal(38, scale)


def _total(c, scale: int | None):
    x = num(c)
    if scale is None:
        return F.coalesce(F.sum(x), F.lit(0.0))
    return F.coalesce(F.sum(x.cast(f"decimal(38,{scale})")).cast("double"), F.lit(0.0))


def monthly_totals(df: DataFrame, date: str, measure: str) -> DataFrame:
    """Month totals of the measure; rows with no date or value dropped.
    Grouped on the month's first day and labelled ``yyyy-MM`` after."""
    ts = time_column(df, date)
    x = num(measure)
    return (df.select(period_bucket(ts, "month").alias("_m"), x.alias("v"))
            .filter(F.col("_m").isNotNull() & F.col("v").isNotNull())
            .groupBy("_m").agg(F.sum("v").alias("total"))
            .select(period_label(F.col("_m"), "month").alias("period"), "total"))


def scalar_kpis(df: DataFrame, cols: KpiColumns) -> DataFrame:
    """K1-K6, K10 in one aggregation, returned long (kpi_id, value, label, unit)."""
    aggs = [F.count(F.lit(1)).cast("double").alias("record_count")]
    if cols.revenue:
        r = num(cols.revenue)
        aggs += [_total(cols.revenue, cols.money_scale).alias("total_revenue"), F.avg(r).alias("average_order_value"),
                 quantile_literal(df, cols.revenue, 0.5).alias("median_order_value")]
    if cols.profit:
        aggs.append(_total(cols.profit, cols.money_scale).alias("total_profit"))
    if cols.quantity:
        aggs.append(F.coalesce(F.sum(num(cols.quantity)), F.lit(0.0)).alias("units_sold"))
    if cols.entity:
        aggs.append(F.count_distinct(F.col(cols.entity)).cast("double").alias("active_customers"))
    wide = df.agg(*aggs)
    none = F.lit(None).cast("string")
    rows = [_row("record_count", F.col("record_count"), none, "count")]
    if cols.revenue:
        rows.append(_row("total_revenue", F.col("total_revenue"), none, "money"))
        skew = F.when(F.col("average_order_value") > SKEW_NOTE_RATIO * F.col("median_order_value"), "skewed")
        rows.append(_row("average_order_value", F.col("average_order_value"), skew.otherwise("even"), "money"))
    if cols.profit:
        rows.append(_row("total_profit", F.col("total_profit"), none, "money"))
    if cols.profit and cols.revenue and cols.profit != cols.revenue:
        margin = F.when(F.col("total_revenue") != 0, F.col("total_profit") / F.col("total_revenue") * 100)
        rows.append(_row("profit_margin", margin, none, "%"))
    if cols.quantity:
        rows.append(_row("units_sold", F.col("units_sold"), none, "count"))
    if cols.entity:
        active = F.when(F.col("active_customers") >= MIN_ENTITIES_ACTIVE, F.col("active_customers"))
        per = F.format_number(F.col("record_count") / F.col("active_customers"), 1)
        rows.append(_row("active_customers", active, per, "count"))
    long = wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    return long.filter(F.col("value").isNotNull())


def _row(kpi_id: str, value, label, unit: str):
    return F.struct(F.lit(kpi_id).alias("kpi_id"), value.cast("double").alias("value"),
                    label.cast("string").alias("label"), F.lit(unit).alias("unit"))


#: KPIs of one aggregate per entity, and of the months' totals.
ENTITY_KPIS = {"repeat_rate", "top_10pct_share"}
MONTHLY_KPIS = {"growth_rate", "strongest_month"}


def entity_kpis(df: DataFrame, cols: KpiColumns) -> DataFrame:
    """K7 repeat rate and K11 top-10% share from one per-entity aggregate."""
    spark = df.sparkSession
    per = df.filter(F.col(cols.entity).isNotNull()).groupBy(cols.entity).agg(
        F.count(F.lit(1)).alias("rows"),
        _total(cols.revenue, cols.money_scale).alias("total") if cols.revenue else F.lit(0.0).alias("total"),
    )
    # the per-entity table feeds several small jobs below; keep it rather than
    # re-aggregate the source for each (lost blocks are recomputed from lineage)
    per = per.persist()
    try:
        stats = per.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rows") > 1).alias("repeat"),
                        F.sum("total").alias("grand")).first()
        n, repeat, grand = int(stats["n"]), int(stats["repeat"]), float(stats["grand"] or 0.0)
        out = []
        if n >= MIN_ENTITIES_REPEAT:
            out.append(("repeat_rate", repeat / n * 100.0, None, "%"))
        if cols.revenue and n >= MIN_ENTITIES_CONCENTRATION and grand:
            k = max(1, int(n * TOP_SHARE))
            top = sum_of_top(per, "total", k, n)
            out.append(("top_10pct_share", top / grand * 100.0, str(k), "%"))
    finally:
        per.unpersist()
    return spark.createDataFrame(out, KPI_SCHEMA)


def monthly_kpis(df: DataFrame, cols: KpiColumns) -> DataFrame:
    """K8 growth (later half vs earlier half of present months) and K9
    strongest month (earliest on ties) from one month-total aggregate."""
    months = monthly_totals(df, cols.date, cols.revenue)
    w = W.orderBy("period")  # months are bounded by the calendar span
    ranked = months.select("period", "total", F.row_number().over(w).alias("i"),
                           F.count(F.lit(1)).over(W.partitionBy()).alias("n"))
    half = F.floor(F.col("n") / 2)
    g = ranked.agg(
        F.first("n").alias("n"),
        F.avg(F.when(F.col("i") <= half, F.col("total"))).alias("earlier"),
        F.avg(F.when(F.col("i") > half, F.col("total"))).alias("later"),
        F.min_by(F.struct("period", "total"), F.struct(-F.col("total"), F.col("period"))).alias("peak"),
        F.avg("total").alias("mean"),
    )
    growth = F.when((F.col("n") >= MIN_MONTHS_GROWTH) & (F.col("earlier") != 0),
                    (F.col("later") - F.col("earlier")) / F.col("earlier") * 100)
    peak = F.when(F.col("n") >= MIN_MONTHS_PEAK, F.col("peak.total"))
    lift = F.when(F.col("mean") != 0, (F.col("peak.total") / F.col("mean") - 1) * 100)
    long = g.select(F.explode(F.array(
        F.struct(F.lit("growth_rate").alias("kpi_id"), growth.alias("value"),
                 F.when(growth > 0, "up").otherwise("down").alias("label"), F.lit("%").alias("unit")),
        F.struct(F.lit("strongest_month").alias("kpi_id"), peak.alias("value"),
                 F.concat(F.col("peak.period"), F.lit(" lift "), F.format_number(lift, 1)).alias("label"),
                 F.lit("money").alias("unit")),
    )).alias("s")).select("s.*")
    return long.filter(F.col("value").isNotNull())


def contextual_kpis(df: DataFrame, measure: str, depth: str | None = None) -> DataFrame:
    """Non-business data - count, mean, median, max (and max depth); never sums."""
    x = num(measure)
    aggs = [F.count(x).cast("double").alias("n"), F.avg(x).alias("mean"), quantile_literal(df, measure, 0.5).alias("median"),
            F.max(x).alias("max")]
    if depth:
        aggs.append(F.max(num(depth)).alias("depth"))
    wide = df.agg(*aggs)
    items = [("observations", "n", "count"), ("average", "mean", "value"), ("typical", "median", "value"),
             ("largest", "max", "value")]
    if depth:
        items.append(("deepest", "depth", "value"))
    rows = [F.struct(F.lit(f"{k}_{measure}" if k != "observations" else k).alias("kpi_id"), F.col(c).alias("value"),
                     F.lit(None).cast("string").alias("label"), F.lit(u).alias("unit")) for k, c, u in items]
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*").filter(F.col("value").isNotNull())


def custom_kpi(df: DataFrame, kpi_id: str, numerator: str, denominator: str | None = None,
               percentage: bool = False) -> DataFrame:
    """Sum of a column, or a ratio of two sums (x100 for a percentage);
    no row when the denominator sums to zero."""
    n = F.coalesce(F.sum(num(numerator)), F.lit(0.0))
    if denominator:
        d = F.coalesce(F.sum(num(denominator)), F.lit(0.0))
        value = F.when(d != 0, n / d * (100.0 if percentage else 1.0))
    else:
        value = n
    unit = "%" if percentage else "value"
    return df.agg(F.lit(kpi_id).alias("kpi_id"), value.alias("value"), F.lit(None).cast("string").alias("label"),
                  F.lit(unit).alias("unit")).filter(F.col("value").isNotNull())


def all_kpis(df: DataFrame, cols: KpiColumns, chosen: list[str] | None = None) -> DataFrame:
    """Every supported KPI, or the chosen ids; families without a chosen one are not computed."""
    wanted = lambda ids: not chosen or bool(ids & set(chosen))
    parts = []
    if not chosen or set(chosen) - ENTITY_KPIS - MONTHLY_KPIS:
        parts.append(scalar_kpis(df, cols))
    if cols.entity and wanted(ENTITY_KPIS):
        parts.append(entity_kpis(df, cols))
    if cols.date and cols.revenue and wanted(MONTHLY_KPIS):
        parts.append(monthly_kpis(df, cols))
    if not parts:
        return df.sparkSession.createDataFrame([], KPI_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if chosen:
        out = out.filter(F.col("kpi_id").isin(*chosen))
    return out
