"""Chart tables and grouped summaries.

Only the tables behind charts are built; drawing is out of scope. Every table
is a grouped aggregation followed by a bounded cut (top-k with
``orderBy().limit()``, which runs as a per-partition top-k and a merge), so no
step gathers an unbounded group. Folding the tail into "Other" uses the total
of all groups minus the kept head, never a collect of the tail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.functions.dates import parse_datetime, time_column
from veritable.functions.exprs import is_time_type, num, period_bucket, period_label, rnd, with_scalars
from veritable.functions.quantiles import grouped_quantile, quantile_literal
from veritable.functions.ranking import near_ranks

# Fixed values of the chart rules.
TOP_N = 8
CALENDAR_NUMBERS = ("year", "month", "day", "week", "day_of_month")
MIN_TREND_POINTS = 4
MAX_GROUPS = 20
MAX_POINTS = 600
HEATMAP_TOP = 15
PIVOT_TOP = 12
HIST_BINS = 32
OTHER_LABEL = "Other"
EMPTY_LABEL = "(empty)"
FLAT_BAND_PCT = 2.0
STRONG_CORRELATION = 0.5
TEXT_DATE_SHARE = 0.8
SCATTER_STRONG, SCATTER_MODERATE = 0.7, 0.35
ORDERED_CATEGORIES = {
    "month_name": ["January", "February", "March", "April", "May", "June", "July", "August",
                   "September", "October", "November", "December"],
    "day_of_week": ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"],
    "quarter": ["Q1", "Q2", "Q3", "Q4"],
    "revenue_tier": ["Small", "Medium", "Large", "Very large"],
}


def _grouped(vals: DataFrame, keys: list[str], col: str, how: str, name: str) -> DataFrame:
    """Aggregate ``col`` per key; medians take the exact grouped quantile
    (bounded per-task memory even for a group holding most rows)."""
    if how == "median":
        return grouped_quantile(vals, keys, col, 0.5).select(*keys, F.col("_q").cast("double").alias(name))
    return vals.groupBy(*keys).agg(_agg(how, F.col(col)).cast("double").alias(name))


def _agg(how: str, x: Column) -> Column:
    if how == "sum":
        return F.sum(x)
    if how == "mean":
        return F.avg(x)
    if how == "count":
        return F.count(F.lit(1))
    if how == "min":
        return F.min(x)
    if how == "max":
        return F.max(x)
    raise ValueError(f"unknown aggregation {how!r}")


def group_label(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.cast("string"), F.lit(EMPTY_LABEL))


def grouped_values(df: DataFrame, group: str, value: str | None, how: str) -> DataFrame:
    """(group, value) with NULL groups labelled "(empty)"; rows without a
    value are dropped (count without a value column counts every row)."""
    g = group_label(group).alias("group")
    if value is None:
        return df.groupBy(g).agg(F.count(F.lit(1)).cast("double").alias("value"))
    x = num(value)
    vals = df.select(g, x.alias("_v")).filter(F.col("_v").isNotNull())
    return _grouped(vals, ["group"], "_v", how, "value")


def fold_other(grouped: DataFrame, limit: int, additive: bool) -> DataFrame:
    """Largest ``limit - 1`` groups plus one "Other" holding the rest
    (additive aggregations only; mean/median keep the top ``limit``).

    Returns (group, value, position). Bounded: the head comes from a top-k,
    the Other value from the grand total minus the head.
    """
    order = [F.col("value").desc_nulls_last(), F.col("group").asc()]
    head = grouped.orderBy(*order).limit(limit)
    stats = grouped.agg(F.count(F.lit(1)).alias("_n"), F.sum("value").alias("_total"))
    ranked = head.select("group", "value", F.row_number().over(W.orderBy(*order)).alias("position"))
    ranked = with_scalars(ranked, stats)
    if not additive:
        return ranked.select("group", "value", "position")
    kept = ranked.filter((F.col("_n") <= limit) | (F.col("position") < limit))
    other = ranked.groupBy("_n", "_total").agg(
        F.sum(F.when(F.col("position") < limit, F.col("value")).otherwise(0.0)).alias("_head")
    ).filter(F.col("_n") > limit).select(
        F.lit(OTHER_LABEL).alias("group"), (F.col("_total") - F.col("_head")).alias("value"),
        F.lit(limit).alias("position"))
    return kept.select("group", "value", "position").unionByName(other)


def custom_grouped(df: DataFrame, group: str, value: str | None, how: str, max_groups: int = MAX_GROUPS) -> DataFrame:
    """C5 bar (20 groups) / pie (8 groups)."""
    additive = how in ("sum", "count") or value is None
    return fold_other(grouped_values(df, group, value, how), max_groups, additive)


def category_bar(df: DataFrame, category: str, measure: str, how: str = "sum") -> DataFrame:
    """Measure by group; calendar-like categories keep natural order (no
    fold), others keep the top 8 with the rest in Other. Needs >= 2 groups."""
    grouped = grouped_values(df, category, measure, how)
    natural = ORDERED_CATEGORIES.get(category)
    if natural:
        pos = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in natural]), F.col("group")).cast("int"),
                         F.lit(len(natural) + 1))
        out = grouped.select("group", "value", pos.alias("position"))
    else:
        out = fold_other(grouped, TOP_N, how in ("sum", "count"))
    n = grouped.agg(F.count(F.lit(1)).alias("_groups"))
    return with_scalars(out, n).filter(F.col("_groups") >= 2).drop("_groups")


def bar_facts(bar: DataFrame) -> DataFrame:
    """Top and bottom named group and the top's share of the shown total."""
    named = bar.filter(F.col("group") != OTHER_LABEL)
    return with_scalars(bar.agg(F.sum("value").alias("total")), named.agg(
        F.min_by("group", F.struct(-F.col("value"), F.col("group"))).alias("top_label"),
        F.max("value").alias("top_value"),
        F.min_by("group", F.struct(F.col("value"), F.col("group"))).alias("bottom_label"),
        F.min("value").alias("bottom_value"),
    )).select("top_label", "top_value", "bottom_label", "bottom_value",
              F.when(F.col("total") != 0, F.col("top_value") / F.col("total") * 100).alias("top_share_pct"))


def trend(df: DataFrame, date: str, measure: str, how: str = "sum") -> DataFrame:
    """Measure per month (yyyy-MM); fewer than 4 months gives no rows."""
    x = num(measure)
    m = period_bucket(time_column(df, date), "month")          # grouped as a date, labelled after
    vals = df.select(m.alias("_m"), x.alias("_v")).filter(F.col("_m").isNotNull() & F.col("_v").isNotNull())
    g = _grouped(vals, ["_m"], "_v", how, "value").select(period_label(F.col("_m"), "month").alias("period"), "value")
    n = g.agg(F.count(F.lit(1)).alias("_n"))
    return with_scalars(g, n).filter(F.col("_n") >= MIN_TREND_POINTS).drop("_n")


def trend_facts(tr: DataFrame) -> DataFrame:
    """First/last value, % change, grew/fell/flat at +-2%, peak month (earliest on ties)."""
    g = tr.agg(
        F.min_by("value", "period").alias("first"), F.max_by("value", "period").alias("last"),
        F.min_by("period", F.struct(-F.col("value"), F.col("period"))).alias("peak_period"),
        F.max("value").alias("peak_value"), F.min("period").alias("first_period"), F.max("period").alias("last_period"),
    )
    change = F.when(F.coalesce(F.col("first"), F.lit(0.0)) != 0,
                    (F.col("last") - F.col("first")) / F.col("first") * 100).otherwise(0.0)
    return g.select("first_period", "last_period", "first", "last", change.alias("change_pct"),
                    F.when(change > FLAT_BAND_PCT, "grew").when(change < -FLAT_BAND_PCT, "fell")
                    .otherwise("stayed flat").alias("direction"), "peak_period", "peak_value")


def distribution(df: DataFrame, measure: str, bins: int = HIST_BINS) -> tuple[DataFrame, DataFrame]:
    """Five-point quantiles and an equal-width histogram over [min, max]
    (last bin closed). Needs >= 20 values and >= 5 distinct."""
    x = num(measure)
    vals = df.select(x.alias("_v")).filter(F.col("_v").isNotNull())
    stats = vals.agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("_v").alias("_d"), F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"), F.avg("_v").alias("mean"),
        quantile_literal(vals, "_v", [0.0, 0.25, 0.5, 0.75, 1.0]).alias("_q"),
    ).filter((F.col("_n") >= 20) & (F.col("_d") >= 5))
    names = ["Lowest", "25% below", "Middle", "25% above", "Highest"]
    points = stats.select(F.posexplode(F.col("_q")).alias("i", "value")).select(
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1).alias("point"),
        rnd(F.col("value"), 2).alias("value"))
    hist = histogram_bins(vals, "_v", stats, bins)
    return points, hist


def histogram_bins(vals: DataFrame, col: str, stats: DataFrame, bins: int) -> DataFrame:
    """Equal-width bins over [min, max]; the maximum falls in the last bin."""
    joined = with_scalars(vals, stats, ["_lo", "_hi"])
    width = (F.col("_hi") - F.col("_lo")) / bins
    idx = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col(col) - F.col("_lo")) / width), F.lit(bins - 1)))
    g = joined.groupBy(idx.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"), F.min("_lo").alias("_lo"), F.min("_hi").alias("_hi"))
    return g.select("bin", (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_start"), "rows")


def custom_histogram(df: DataFrame, measure: str) -> tuple[DataFrame, DataFrame]:
    """bins = min(40, max(10, floor(sqrt n))); count, mean, median, min, max (3 dp)."""
    x = num(measure)
    vals = df.select(x.alias("_v")).filter(F.col("_v").isNotNull())
    stats = vals.agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                     F.avg("_v").alias("_mean"), quantile_literal(vals, "_v", 0.5).alias("_median"))
    stats = stats.withColumn("_bins", F.least(F.lit(40), F.greatest(F.lit(10), F.floor(F.sqrt("_n")))).cast("int"))
    items = [("Rows", "_n"), ("Average", "_mean"), ("Median", "_median"), ("Minimum", "_lo"), ("Maximum", "_hi")]
    summary = stats.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("statistic"), F.col(c).cast("double").alias("value")) for name, c in items
    ])).alias("s")).select(F.col("s.statistic").alias("statistic"), rnd(F.col("s.value"), 3).alias("value"))
    width = (F.col("_hi") - F.col("_lo")) / F.col("_bins")
    idx = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.col("_bins") - 1))
    hist = with_scalars(vals, stats, ["_lo", "_hi", "_bins"]).groupBy(idx.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"))
    return summary, hist


def box_summary(df: DataFrame, group: str, measure: str, top: int = TOP_N, places: int = 2) -> DataFrame:
    """Count, median, mean, min, max per group for the ``top`` groups
    with the highest median; needs >= 2 groups."""
    x = num(measure)
    vals = (df.select(F.col(group).cast("string").alias("group"), x.alias("_v"))
            .filter(F.col("group").isNotNull() & F.col("_v").isNotNull()))
    # exact per-group median without a per-group map in one task (a hot
    # group may hold a third of the rows)
    med = grouped_quantile(vals, ["group"], "_v", 0.5).select("group", F.col("_q").alias("median"))
    g = (vals.groupBy("group").agg(F.count(F.lit(1)).cast("bigint").alias("rows"), F.avg("_v").alias("mean"),
                                   F.min("_v").alias("min"), F.max("_v").alias("max"))
         .join(med, "group"))
    head = g.orderBy(F.col("median").desc(), F.col("group")).limit(top)
    n = head.agg(F.count(F.lit(1)).alias("_n"))
    out = with_scalars(head, n).filter(F.col("_n") >= 2)
    return out.select(F.col("group").alias(group), "rows", *[rnd(c, places).alias(c) for c in ("median", "mean", "min", "max")])


def overall_box(df: DataFrame, measure: str) -> DataFrame:
    """C9 without a group: one row of count, median, mean, min, max (3 dp)."""
    x = num(measure)
    return df.agg(F.count(x).cast("bigint").alias("rows"), rnd(quantile_literal(df, measure, 0.5), 3).alias("median"),
                  rnd(F.avg(x), 3).alias("mean"), rnd(F.min(x), 3).alias("min"), rnd(F.max(x), 3).alias("max"))


def pivot_sum(df: DataFrame, row: str, column: str, measure: str, top: int | None = PIVOT_TOP) -> DataFrame:
    """Long-form row x column sums for the ``top`` largest rows and columns
    by margin (None: all); needs >= 2 x 2."""
    x = num(measure)
    cells = (df.select(F.col(row).cast("string").alias("row"), F.col(column).cast("string").alias("col"), x.alias("_v"))
             .filter(F.col("row").isNotNull() & F.col("col").isNotNull() & F.col("_v").isNotNull())
             .groupBy("row", "col").agg(F.sum("_v").alias("value")))
    sizes = cells.agg(F.count_distinct("row").alias("_r"), F.count_distinct("col").alias("_c"))
    kept = cells
    if top is not None:
        for side in ("row", "col"):
            margin = cells.groupBy(side).agg(F.sum("value").alias("_t")).orderBy(F.col("_t").desc(), side).limit(top)
            kept = kept.join(F.broadcast(margin.select(side)), side)
    return with_scalars(kept, sizes).filter((F.col("_r") >= 2) & (F.col("_c") >= 2)).select(
        F.col("row").alias(row), F.col("col").alias(column), "value")


def strongest_cell(pivot: DataFrame, row: str, column: str) -> DataFrame:
    return pivot.agg(F.min_by(F.struct(F.col(row), F.col(column), F.col("value")),
                               F.struct(-F.col("value"), F.col(row), F.col(column))).alias("s")).select("s.*")


def crosstab(df: DataFrame, x: str, y: str, top: int | None = HEATMAP_TOP) -> DataFrame:
    """Counts of the ``top`` most frequent values of each side (None: all); >= 2 x 2.

    The rows are read once: cells are counted, and margins are sums of cells.
    """
    every = df.select(F.col(x).cast("string").alias("x"), F.col(y).cast("string").alias("y")).groupBy("x", "y").agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"))
    cells = every.where("x IS NOT NULL AND y IS NOT NULL")
    if top is not None:
        for side in ("x", "y"):
            margin = every.groupBy(side).agg(F.sum("rows").alias("_t")).orderBy(F.col("_t").desc(), side).limit(top)
            cells = cells.join(F.broadcast(margin.select(side)), side)
    sizes = cells.agg(F.count_distinct("x").alias("_r"), F.count_distinct("y").alias("_c"))
    return with_scalars(cells, sizes).filter((F.col("_r") >= 2) & (F.col("_c") >= 2)).select(
        F.col("x").alias(x), F.col("y").alias(y), "rows")


def correlation_matrix(df: DataFrame, measures: list[str]) -> DataFrame:
    """Pairwise Pearson r (pairwise complete, 2 dp) of all the measures
    (calendar numbers and constants are none); one fused aggregation of all
    pairs. Fewer than 3 usable measures: no rows."""
    usable = [m for m in measures if m.casefold() not in CALENDAR_NUMBERS]
    ends = df.agg(*[F.min(num(m)).alias(f"l{i}") for i, m in enumerate(usable)],
                  *[F.max(num(m)).alias(f"h{i}") for i, m in enumerate(usable)]).first() if len(usable) >= 3 else None
    usable = [m for i, m in enumerate(usable) if ends and ends[f"l{i}"] is not None and ends[f"l{i}"] < ends[f"h{i}"]]
    if len(usable) < 3:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    aggs = []
    pairs = []
    for i, a in enumerate(usable):
        for b in usable[i + 1:]:
            k = len(pairs)
            pairs.append((a, b))
            aggs.append(F.corr(num(a), num(b)).alias(f"r{k}"))
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.a", "s.b", rnd(F.col("s.r"), 2).alias("r"))


def strongest_pair(matrix: DataFrame) -> DataFrame:
    return matrix.filter(F.abs("r") >= STRONG_CORRELATION).orderBy(F.abs("r").desc(), "a", "b").limit(1)


def scatter_relationship(df: DataFrame, x: str, y: str) -> DataFrame:
    """R over complete rows (>= 20), strength strong/moderate/weak."""
    xs, ys = num(x), num(y)
    g = df.select(xs.alias("_x"), ys.alias("_y")).filter(F.col("_x").isNotNull() & F.col("_y").isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("r"))
    a = F.abs(F.col("r"))
    return g.filter(F.col("n") >= 20).select(
        F.col("n").cast("bigint").alias("n"), rnd(F.col("r"), 4).alias("r"),
        F.when(a >= SCATTER_STRONG, "strong").when(a >= SCATTER_MODERATE, "moderate").otherwise("weak").alias("strength"))


SAMPLE_SEED = "42"


def scatter_sample(df: DataFrame, x: str, y: str, key: list[str], points: int = MAX_POINTS) -> DataFrame:
    """A deterministic sample of ``points`` complete rows, chosen by the
    smallest MD5 of a content key (top-k, no full sort).

    The key is the text of the key columns and the seed joined by ``|``; MD5
    of that text is the same in any engine, so the sample can be reproduced
    outside Spark (integer or text key columns print alike everywhere)."""
    xs, ys = num(x), num(y)
    h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(SAMPLE_SEED)))
    return (df.select(*key, xs.alias(x), ys.alias(y), h.alias("_h"))
            .filter(F.col(x).isNotNull() & F.col(y).isNotNull())
            .orderBy("_h", *key).limit(points).drop("_h"))


def colour_groups(df: DataFrame, group: str, top: int = 3) -> DataFrame:
    """A12 colouring: the 3 most frequent groups keep their name, others are Other."""
    heads = df.groupBy(F.col(group).cast("string").alias("g")).count().orderBy(F.col("count").desc(), "g").limit(top)
    return df.join(F.broadcast(heads.select(F.col("g").alias("_g"))), F.col(group).cast("string") == F.col("_g"), "left") \
        .withColumn("colour_group", F.coalesce(F.col("_g"), F.lit(OTHER_LABEL))).drop("_g")


def line_table(df: DataFrame, x: str, y: str, how: str = "sum", max_points: int = MAX_POINTS) -> DataFrame:
    """Y aggregated per x. A time x is bucketed to months when it spans
    more than 180 days, to days when more than 3; then the ordered points are
    thinned to ``max_points`` evenly spaced positions floor(k (n-1) / (m-1));
    only the ranges of x that hold one of these are sorted."""
    ys = num(y)
    dtype = df.schema[x].dataType
    timed = is_time_type(dtype)
    if isinstance(dtype, T.StringType):      # text dates count as dates if most of the values are some
        parsed, there = df.agg(F.count(parse_datetime(F.col(x))), F.count(x)).first()
        timed = there > 0 and parsed >= TEXT_DATE_SHARE * there
    if timed:
        ts = time_column(df, x).cast("timestamp")
        span = df.agg(((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 86400e6).alias("_days"))
        bucket = (F.when(F.col("_days") > 180, F.date_trunc("month", ts))
                  .when(F.col("_days") > 3, F.date_trunc("day", ts)).otherwise(ts))
        base = with_scalars(df, span).select(bucket.alias("x"), ys.alias("_y"))
    else:
        base = df.select(F.col(x).alias("x"), ys.alias("_y"))
    g = _grouped(base.filter(F.col("x").isNotNull() & F.col("_y").isNotNull()), ["x"], "_y", how, "y")
    n = g.count()
    if n < 2:
        return g.limit(0).select(F.col("x").alias(x), F.col("y").alias(y))
    if n <= max_points:
        return g.select(F.col("x").alias(x), F.col("y").alias(y))
    m = max_points - 1
    ranked = near_ranks(g, "x", [i * (n - 1) // m for i in range(max_points)])
    k = F.ceil(F.col("_rank") * m / F.lit(n - 1))
    keep = F.floor(k * F.lit(n - 1) / m) == F.col("_rank")
    return ranked.filter(keep).select(F.col("x").alias(x), F.col("y").alias(y))


def evidence_counts(df: DataFrame, group: str, top: int = TOP_N) -> DataFrame:
    """Records per group, largest 8."""
    return (df.groupBy(F.col(group).cast("string").alias(group)).agg(F.count(F.lit(1)).cast("bigint").alias("records"))
            .filter(F.col(group).isNotNull()).orderBy(F.col("records").desc(), group).limit(top))

