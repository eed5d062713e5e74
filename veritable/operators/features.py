"""Derived measures.

Row features are plain column expressions. Features that need a statistic of
the whole column (quartile cut points, the largest discount) take it from a
one-row aggregate attached by a broadcast cross join. Per-entity values are a
grouped aggregate joined back on the entity key rather than a window: the
aggregate is map-side combined and AQE splits a hot entity in the join, where a
window would sort one giant entity in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.functions.dates import time_column
from veritable.functions.exprs import rnd, num, safe_name, with_scalars

# Labels and limits of the standard bands.
TIER_LABELS = ("Small", "Medium", "Large", "Very large")
UNCLASSIFIED = "Unclassified"
AGE_BANDS = ((24, "Under 25"), (34, "25-34"), (44, "35-44"), (54, "45-54"), (64, "55-64"), (200, "65+"))
DEFAULT_WEEKEND = (4, 5)  # Friday and Saturday, Monday = 0
DISCOUNT_PERCENT_CUTOFF = 1.5


def add_calendar(df: DataFrame, date_column: str, weekend_days=DEFAULT_WEEKEND) -> DataFrame:
    """year, quarter 'Qn', month, month name, day name, weekend flag."""
    ts = time_column(df, date_column)
    return df.select(
        "*",
        F.year(ts).alias("year"),
        F.concat(F.lit("Q"), F.quarter(ts).cast("string")).alias("quarter"),
        F.month(ts).alias("month"),
        F.date_format(ts, "MMMM").alias("month_name"),
        F.date_format(ts, "EEEE").alias("day_of_week"),
        F.when(ts.isNull(), F.lit(False)).otherwise(F.weekday(ts).isin(*weekend_days)).alias("is_weekend"),
    )


def cost_is_per_unit(cost_column: str) -> bool:
    name = cost_column.casefold()
    return "unit" in name or "per_" in name


def add_profit(df: DataFrame, revenue: str, cost: str, quantity: str | None = None) -> DataFrame:
    """profit = revenue - cost (x quantity when cost is per unit);
    margin % (2 dp) only where revenue > 0."""
    r, c = num(revenue), num(cost)
    if quantity and quantity in df.columns and cost_is_per_unit(cost):
        c = c * num(quantity)
    profit = r - c
    margin = F.when(r > 0, rnd(profit / r * 100, 2))
    return df.select("*", profit.alias("profit"), margin.alias("profit_margin_pct"))


def add_net_revenue(df: DataFrame, revenue: str, discount: str) -> DataFrame:
    """revenue x (1 - discount); a discount column whose max exceeds 1.5 is
    read as percent. The max is a one-row aggregate broadcast to every row."""
    d = F.coalesce(num(discount), F.lit(0.0))
    scal = df.agg(F.max(d).alias("_dmax"))
    scaled = F.when(F.col("_dmax") > DISCOUNT_PERCENT_CUTOFF, d / 100.0).otherwise(d)
    out = with_scalars(df, scal)
    return out.select(*df.columns, rnd(num(revenue) * (1 - scaled), 2).alias("net_revenue"))


def tier_cut_points(df: DataFrame, revenue: str, exact: bool = True) -> DataFrame:
    """Quartile cut points as a one-row frame (exact, bounded memory)."""
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    if exact:
        from veritable.functions.quantiles import global_quantiles

        cuts = global_quantiles(df, {revenue: probs})[revenue]
        return df.sparkSession.createDataFrame([(cuts if cuts[0] is not None else None,)], "_cuts array<double>")
    return df.agg(F.percentile_approx(num(revenue), probs, 100000).alias("_cuts"))


def add_size_band(df: DataFrame, revenue: str, column: str = "revenue_tier", exact: bool = True) -> DataFrame:
    """quartile cut points, right-closed, lowest included. If any two cut
    points coincide every row is "Unclassified"; NULL values stay NULL."""
    x = num(revenue)
    cuts = tier_cut_points(df, revenue, exact)
    e = [F.col("_cuts")[i] for i in range(5)]
    distinct = (e[0] < e[1]) & (e[1] < e[2]) & (e[2] < e[3]) & (e[3] < e[4])
    band = (
        F.when(~F.coalesce(distinct, F.lit(False)), F.lit(UNCLASSIFIED))
        .when(x.isNull(), F.lit(None))
        .when(x <= e[1], TIER_LABELS[0])
        .when(x <= e[2], TIER_LABELS[1])
        .when(x <= e[3], TIER_LABELS[2])
        .when(x <= e[4], TIER_LABELS[3])
    )
    out = with_scalars(df, cuts)
    return out.select(*df.columns, band.alias(column))


def add_entity_value(df: DataFrame, entity: str, revenue: str, prefix: str = "customer") -> DataFrame:
    """per-entity total (2 dp), count of non-null values, mean (2 dp) on
    every row; rows with a NULL entity get NULLs."""
    x = num(revenue)
    per = df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(
        rnd(F.sum(x), 2).alias(f"{prefix}_total_value"),
        F.count(x).alias(f"{prefix}_order_count"),
        rnd(F.avg(x), 2).alias(f"{prefix}_average_order"),
    )
    return df.join(per, on=entity, how="left").select(
        *df.columns, f"{prefix}_total_value", f"{prefix}_order_count", f"{prefix}_average_order"
    )


def add_revenue_per_unit(df: DataFrame, revenue: str, quantity: str) -> DataFrame:
    """revenue / quantity (2 dp) where quantity > 0."""
    q = num(quantity)
    return df.select("*", F.when(q > 0, rnd(num(revenue) / q, 2)).alias("revenue_per_unit"))


def add_age_band(df: DataFrame, age: str, column: str = "age_band") -> DataFrame:
    """(0,24], (24,34], ... (64,200]; anything else NULL."""
    x = num(age)
    band = F.when(x.isNull() | (x <= 0), F.lit(None))
    for upto, label in AGE_BANDS:
        band = band.when(x <= upto, label)
    return df.select("*", band.alias(column))


def add_custom_bands(df: DataFrame, column: str, source: str, bands: list[dict], otherwise: str = "Other") -> DataFrame:
    """F8: ascending ``upto`` limits with ``<=``; everything else, NULL
    included, gets ``otherwise``."""
    if source not in df.columns or not bands:
        return df
    x = num(source)
    expr = None
    for band in sorted(bands, key=lambda b: float(b.get("upto", 0))):
        cond = x <= float(band.get("upto", 0))
        label = str(band.get("label", "Band"))
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return df.select("*", expr.otherwise(otherwise).alias(column))


def add_rule_band(df: DataFrame, label: str, source: str, operator: str, threshold: float,
                  yes: str | None = None, no: str | None = None) -> tuple[DataFrame, str]:
    """a labelled threshold rule becomes a column named from the label.

    The operator is honoured as written (>, >=, <, <=, =, !=) and a NULL value
    stays NULL (unknown), rather than being sent to either side.
    """
    name = safe_name(label)
    x = num(source)
    ops = {">": x > threshold, ">=": x >= threshold, "<": x < threshold, "<=": x <= threshold,
           "=": x == threshold, "!=": x != threshold}
    cond = ops[operator]
    yes_label = yes or label
    no_label = no or f"Not {label}"
    return df.select("*", F.when(x.isNull(), F.lit(None)).when(cond, yes_label).otherwise(no_label).alias(name)), name


def apply_all(df: DataFrame, suggestions: list[tuple[str, dict]]) -> tuple[DataFrame, list[str]]:
    """apply every suggested feature; one that cannot be built is skipped
    with a warning instead of stopping the run."""
    builders = {
        "calendar": add_calendar, "profit": add_profit, "net_revenue": add_net_revenue,
        "size_band": add_size_band, "entity_value": add_entity_value,
        "revenue_per_unit": add_revenue_per_unit, "age_band": add_age_band,
    }
    warnings = []
    for kind, args in suggestions:
        try:
            df = builders[kind](df, **args)
        except Exception as exc:  # noqa: BLE001 - a failing feature is skipped, as documented
            warnings.append(f"{kind}: {exc}")
    return df, warnings


def suggest_features(roles: dict[str, str], columns: list[str]) -> list[tuple[str, dict]]:
    """which standard features the columns support (driver-side, by name)."""
    import re

    def find(*words, role=None):
        for w in words:
            for c in columns:
                if w in c.casefold() and (role is None or roles.get(c) == role):
                    return c
        return None

    out: list[tuple[str, dict]] = []
    date = next((c for c in columns if roles.get(c) == "datetime"), None)
    if date:
        out.append(("calendar", {"date_column": date}))
    revenue = find("revenue", "sales", "amount", "total", "price", role="measure")
    cost = find("cost", "cogs", "expense", role="measure")
    qty = find("quantity", "qty", "units", role="measure")
    if revenue and cost:
        out.append(("profit", {"revenue": revenue, "cost": cost, "quantity": qty}))
    discount = find("discount", role="measure")
    if revenue and discount:
        out.append(("net_revenue", {"revenue": revenue, "discount": discount}))
    if revenue:
        out.append(("size_band", {"revenue": revenue}))
    customer = next((c for c in columns if re.search(r"(customer|client|account|buyer)", c, re.I)
                     and roles.get(c) in ("identifier", "category", "text")), None)
    if customer and revenue:
        out.append(("entity_value", {"entity": customer, "revenue": revenue}))
    if revenue and qty:
        out.append(("revenue_per_unit", {"revenue": revenue, "quantity": qty}))
    age = next((c for c in columns if c.casefold() == "age" and roles.get(c) == "measure"), None)
    if age:
        out.append(("age_band", {"age": age}))
    return out
