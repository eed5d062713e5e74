"""Column operations for cleaning.

Scalars needed inside row expressions are one-row aggregates attached with a
broadcast cross join of that single row (a mean, a mode), or, for an exact
median, one number returned by the bounded-memory quantile method and used
as a literal.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.functions.dates import time_column
from veritable.functions.exprs import keep_null_not, text_key
from veritable.functions.exprs import with_scalars as attach

# Words that mark rows a user usually wants excluded.
STATUS_NAME_WORDS = ("status", "state", "type", "stage")
EXCLUDABLE_VALUE_WORDS = ("cancel", "void", "test", "refund", "return", "draft")
DROP_MISSING_RATE = 0.6
TEXT_DROP_DISTINCT_SHARE = 0.8


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach a one-row DataFrame of scalars to every row (scalar subqueries)."""
    return attach(df, scalars)


def filter_rows(df: DataFrame, column: str, exclude: list) -> DataFrame:
    """Drop rows whose value is in ``exclude`` (case-insensitive); NULLs stay."""
    if column not in df.columns or not exclude:
        return df
    wanted = [str(v).strip().casefold() for v in exclude]
    return df.filter(keep_null_not(text_key(column).isin(wanted)))


def drop_missing_rows(df: DataFrame, column: str) -> DataFrame:
    """P3."""
    return df.filter(F.col(column).isNotNull()) if column in df.columns else df


def drop_column(df: DataFrame, column: str) -> DataFrame:
    """P4."""
    return df.drop(column)


def rename_column(df: DataFrame, column: str, new_name: str) -> DataFrame:
    """P5: no-op when the new name is blank or the same."""
    if not new_name or not new_name.strip() or new_name == column or column not in df.columns:
        return df
    return df.withColumnRenamed(column, new_name.strip())


def convert_expr(df: DataFrame, column: str, target: str):
    c = F.col(column)
    if target == "number":
        return F.regexp_replace(c.cast("string"), r"[^\d.\-eE]", "").try_cast("double")
    if target == "date":
        return time_column(df, column)
    if target in ("text", "category"):
        return c.cast("string")
    raise ValueError(f"unknown target {target!r}")


def convert_column(df: DataFrame, column: str, target: str) -> DataFrame:
    """Convert to number, date, text or category."""
    if column not in df.columns:
        return df
    return df.withColumn(column, convert_expr(df, column, target))


def convert_report(df: DataFrame, column: str, target: str) -> DataFrame:
    """Blanks before/after a conversion and the count that became unreadable."""
    before = F.count_if(F.col(column).isNull())
    after = F.count_if(convert_expr(df, column, target).isNull())
    return df.agg(
        F.lit(column).alias("column_name"), F.lit(target).alias("target"),
        before.cast("bigint").alias("blanks_before"), after.cast("bigint").alias("blanks_after"),
        F.greatest(after - before, F.lit(0)).cast("bigint").alias("unreadable"),
    )


def mode_value(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value, smallest on ties (pandas ``mode().iloc[0]``).

    A grouped count with map-side combine, then a top-1: never one big group.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.col("cnt").desc(), F.col(column).asc()).limit(1).select(F.col(column).alias("_fill"))


def fill_missing(df: DataFrame, column: str, strategy: str, exact: bool = True) -> DataFrame:
    """Fill blanks with median, mean, mode, zero or a label."""
    if column not in df.columns:
        return df
    c = F.col(column)
    others = [F.col(n) for n in df.columns]
    if strategy in ("median", "mean"):
        x = c.try_cast("double")
        if strategy == "median" and exact:
            from veritable.functions.quantiles import global_quantiles

            value = global_quantiles(df, {column: [0.5]})[column][0]     # exact, bounded memory
            return df.withColumn(column, F.coalesce(x, F.lit(value).cast("double")))
        stat = F.percentile_approx(x, 0.5, 100000) if strategy == "median" else F.avg(x)
        scalars = df.agg(stat.alias("_fill"))
        filled = F.coalesce(x, F.col("_fill"))
    elif strategy == "zero":
        return df.withColumn(column, F.coalesce(c.try_cast("double"), F.lit(0.0)))
    elif strategy == "mode":
        scalars = mode_value(df, column)
        filled = F.coalesce(c, F.col("_fill"))
        # An empty column has no mode: the left join keeps the rows untouched.
        joined = df.join(F.broadcast(scalars), how="left")
        return joined.select(*[filled.alias(n) if n == column else F.col(n) for n in df.columns])
    else:
        label = strategy if strategy else "Unknown"
        return df.withColumn(column, F.coalesce(c.cast("string"), F.lit(label)))
    joined = with_scalars(df, scalars)
    return joined.select(*[filled.alias(n) if n == column else F.col(n) for n in df.columns]) if others else joined


def suggest_actions(profile: DataFrame) -> DataFrame:
    """One suggested action per profiled column.

    constant -> drop; >=60% empty -> drop; measure with blanks -> fill median;
    category with blanks -> fill "Unknown"; free text with >80% distinct ->
    drop; else keep. ``profile`` needs role, missing_rate, unique_count, n_rows.
    """
    rate = F.col("missing_count") / F.col("n_rows")
    role = F.col("role")
    action = (
        F.when(role == "constant", "drop")
        .when(rate >= DROP_MISSING_RATE, "drop")
        .when((role == "measure") & (rate > 0), "fill")
        .when((role == "category") & (rate > 0), "fill")
        .when((role == "text") & (F.col("unique_count") > F.col("n_rows") * TEXT_DROP_DISTINCT_SHARE), "drop")
        .otherwise("keep")
    )
    strategy = (
        F.when(action != "fill", F.lit(None).cast("string"))
        .when(role == "measure", "median")
        .otherwise("Unknown")
    )
    return profile.select("column_name", "role", action.alias("action"), strategy.alias("strategy"))


def apply_action(df: DataFrame, column: str, action: str, **payload) -> DataFrame:
    """Dispatch one column action."""
    if action == "drop":
        return drop_column(df, column)
    if action == "rename":
        return rename_column(df, column, payload.get("new_name", ""))
    if action == "convert":
        return convert_column(df, column, payload.get("target", "number"))
    if action == "fill":
        return fill_missing(df, column, payload.get("strategy", "median"))
    if action == "drop_missing":
        return drop_missing_rows(df, column)
    return df


def excludable_values(profile: DataFrame, top_values: DataFrame) -> DataFrame:
    """P10: suspicious values of the first status-like category column.

    ``profile`` has (position, column_name, role); ``top_values`` is the
    category_stats output. Returns (column_name, value) rows to exclude.
    """
    name_hit = F.lit(False)
    for word in STATUS_NAME_WORDS:
        name_hit = name_hit | F.lower(F.col("column_name")).contains(word)
    value_hit = F.lit(False)
    for word in EXCLUDABLE_VALUE_WORDS:
        value_hit = value_hit | F.lower(F.col("value")).contains(word)
    cands = profile.filter((F.col("role") == "category") & name_hit).select("position", "column_name")
    hits = top_values.join(cands, "column_name").filter(value_hit)
    first = hits.agg(F.min("position").alias("position"))
    return hits.join(first, "position").select("column_name", "value").distinct()


def numeric_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns where at least min(n, max(3, ceil(0.7 n))) values parse."""
    names = [n for n in (columns or df.columns) if df.schema[n].dataType.typeName() != "boolean"]
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count(F.col(n).cast("string").try_cast("double")).alias(f"p{i}") for i, n in enumerate(names)]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(n).alias("column_name"), F.col(f"p{i}").alias("parsed")) for i, n in enumerate(names)]
    long = wide.select("_n", F.explode(F.array(*rows)).alias("s")).select("_n", "s.*")
    need = F.least(F.col("_n"), F.greatest(F.lit(3), F.ceil(F.col("_n") * 0.7)))
    return long.select("column_name", F.col("parsed").cast("bigint").alias("parsed"),
                       (F.col("parsed") >= need).alias("is_numeric"))


def need_rows(n: int) -> int:
    return min(n, max(3, math.ceil(0.7 * n)))
