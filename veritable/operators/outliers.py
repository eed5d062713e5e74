"""IQR outliers.

Bounds are Q1 - 1.5 IQR and Q3 + 1.5 IQR from linear-interpolated quartiles.
Quartiles are exact and shared across columns (bounded-memory bracket
method); the row operators attach the one-row bounds as scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.functions.exprs import with_scalars
from veritable.functions.quantiles import global_quantiles

# Fixed values of the outlier rule.
IQR_MULTIPLIER = 1.5
MIN_ROWS_FOR_OUTLIERS = 30
MIN_DISTINCT = 5
MAX_OUTLIER_SHARE = 0.15
UNUSUAL_SUFFIX = "_is_unusual"


def outlier_bounds(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """O1/O2 facts for many columns.

    Columns: column_name, n, enough_distinct, q1, q3, iqr, lower, upper,
    low_count, high_count, count, share, eligible (>=30 values, >=5 distinct,
    IQR > 0 and at least one flagged value).

    Quartiles are exact (fused ``percentile`` for low-cardinality columns, the
    bounded-memory bracket method above that) and come back to the driver as
    a handful of numbers; the flagged counts are then one fused
    aggregation with literal bounds. The ">= 5 distinct" test is settled by
    min, quartiles and max when they differ, else by an exact distinct count
    of that column alone.
    """
    spark = df.sparkSession
    first = df.agg(*[agg for i, c in enumerate(columns) for agg in (
        F.count(F.col(c).try_cast("double")).alias(f"n{i}"), F.min(F.col(c).try_cast("double")).alias(f"lo{i}"),
        F.max(F.col(c).try_cast("double")).alias(f"hi{i}"))]).first()
    counts_n = {c: int(first[f"n{i}"]) for i, c in enumerate(columns)}
    if exact:
        quart = global_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns}, counts=counts_n)
    else:
        row = df.agg(*[F.percentile_approx(F.col(c).try_cast("double"), [0.25, 0.5, 0.75], 100000).alias(f"q{i}")
                       for i, c in enumerate(columns)]).first()
        quart = {c: (row[f"q{i}"] or [None, None, None]) for i, c in enumerate(columns)}
    # five different values among min, quartiles and max prove ">= 5 distinct";
    # only columns where they coincide need an exact distinct count
    enough = {}
    for i, c in enumerate(columns):
        points = {first[f"lo{i}"], first[f"hi{i}"], *quart[c]} - {None}
        if len(points) >= MIN_DISTINCT:
            enough[c] = True
    unsure = [c for c in columns if c not in enough]
    if unsure:
        row = df.agg(*[F.count_distinct(F.col(c).try_cast("double")).alias(f"d{i}") for i, c in enumerate(unsure)]).first()
        enough.update({c: int(row[f"d{i}"]) >= MIN_DISTINCT for i, c in enumerate(unsure)})
    rows = []
    for c in columns:
        q1, _q2, q3 = quart[c]
        rows.append((c, counts_n[c], enough[c], q1, q3))
    q = spark.createDataFrame(rows, "column_name string, n bigint, enough_distinct boolean, q1 double, q3 double")
    counts = []
    for i, (c, n, d, q1, q3) in enumerate(rows):
        if q1 is None:
            counts += [F.lit(0).alias(f"l{i}"), F.lit(0).alias(f"h{i}")]
            continue
        lo, hi = q1 - IQR_MULTIPLIER * (q3 - q1), q3 + IQR_MULTIPLIER * (q3 - q1)
        x = F.col(c).try_cast("double")
        counts += [F.count_if(x < F.lit(lo)).alias(f"l{i}"), F.count_if(x > F.lit(hi)).alias(f"h{i}")]
    c_wide = df.agg(*counts)
    c_rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"l{i}").cast("bigint").alias("low_count"),
                       F.col(f"h{i}").cast("bigint").alias("high_count")) for i, (c, *_r) in enumerate(rows)]
    c_long = c_wide.select(F.explode(F.array(*c_rows)).alias("s")).select("s.*")
    iqr = F.col("q3") - F.col("q1")
    out = q.select("*", iqr.alias("iqr"), (F.col("q1") - IQR_MULTIPLIER * iqr).alias("lower"),
                   (F.col("q3") + IQR_MULTIPLIER * iqr).alias("upper")).join(F.broadcast(c_long), "column_name")
    total = F.col("low_count") + F.col("high_count")
    eligible = (F.col("n") >= MIN_ROWS_FOR_OUTLIERS) & F.col("enough_distinct") & (F.col("iqr") > 0) & (total > 0)
    return out.select(
        "column_name", "n", "enough_distinct", "q1", "q3", "iqr", "lower", "upper", "low_count", "high_count",
        total.cast("bigint").alias("count"), (total / F.col("n")).alias("share"), F.coalesce(eligible, F.lit(False)).alias("eligible"),
    )


def outlier_candidates(bounds: DataFrame) -> DataFrame:
    """O2: eligible columns with share <= 0.15, most severe first."""
    return bounds.filter(F.col("eligible") & (F.col("share") <= MAX_OUTLIER_SHARE)).orderBy(
        F.col("share").desc(), F.col("column_name")
    )


def _bounds_row(bounds: DataFrame, column: str) -> DataFrame:
    return bounds.filter(F.col("column_name") == column).select(
        F.col("lower").alias("_lo"), F.col("upper").alias("_hi")
    ).limit(1)


def outside(column: str):
    x = F.col(column).try_cast("double")
    return (x < F.col("_lo")) | (x > F.col("_hi"))


def remove_outliers(df: DataFrame, bounds: DataFrame, column: str) -> DataFrame:
    """O3: drop rows outside the bounds; NULL values stay."""
    joined = with_scalars(df, _bounds_row(bounds, column))
    return joined.filter(~F.coalesce(outside(column), F.lit(False))).select(*df.columns)


def cap_outliers(df: DataFrame, bounds: DataFrame, column: str) -> DataFrame:
    """Clip to the bounds; NULL stays NULL."""
    x = F.col(column).try_cast("double")
    capped = F.when(x < F.col("_lo"), F.col("_lo")).when(x > F.col("_hi"), F.col("_hi")).otherwise(x)
    joined = with_scalars(df, _bounds_row(bounds, column))
    return joined.select(*[capped.alias(c) if c == column else F.col(c) for c in df.columns])


def flag_outliers(df: DataFrame, bounds: DataFrame, column: str) -> DataFrame:
    """Add ``<column>_is_unusual``; NULL values are not unusual."""
    joined = with_scalars(df, _bounds_row(bounds, column))
    return joined.select(*df.columns, F.coalesce(outside(column), F.lit(False)).alias(f"{column}{UNUSUAL_SUFFIX}"))


def outlier_examples(df: DataFrame, bounds: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Lowest n below and highest n above the bounds (top-k, no full sort)."""
    x = F.col(column).try_cast("double")
    joined = with_scalars(df, _bounds_row(bounds, column))
    low = joined.filter(x < F.col("_lo")).select(F.lit("low").alias("side"), x.alias("value")).orderBy("value").limit(n)
    high = joined.filter(x > F.col("_hi")).select(F.lit("high").alias("side"), x.alias("value")).orderBy(F.col("value").desc()).limit(n)
    return low.unionByName(high)
