"""Shared column expressions (period keys, safe numbers, NULL-aware negation).

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen. Nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAINS = ("day", "week", "month", "quarter", "year")

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType,
)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES) and not isinstance(dtype, T.BooleanType)


def is_time_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, TIME_TYPES)


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def scalar_columns(one_row: DataFrame, names: list[str] | None = None) -> list[Column]:
    """The columns of a one-row DataFrame as scalar subqueries.

    Catalyst runs each subquery once (subqueries over the same aggregate are
    merged into one job) and uses the value as a constant in the hosting
    projection: no join and no exchange of the big side. ``one_row`` must
    return at most one row; none gives NULL.
    """
    return [one_row.select(n).scalar().alias(n) for n in (names or one_row.columns)]


def with_scalars(df: DataFrame, one_row: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Attach the values of a one-row DataFrame to every row of ``df``."""
    return df.select("*", *scalar_columns(one_row, names))


def num(c: str | Column) -> Column:
    """Coerce to double; text that is not a number becomes NULL (ANSI-safe)."""
    return col(c).try_cast("double")


def text_key(c: str | Column) -> Column:
    """Case-folded, trimmed text form used for case-insensitive matching."""
    return F.lower(F.trim(col(c).cast("string")))


def keep_null_not(pred: Column) -> Column:
    """Negation that keeps rows where the predicate is NULL (pandas semantics)."""
    return ~F.coalesce(pred, F.lit(False))


def true_only(pred: Column) -> Column:
    """A predicate where NULL counts as False."""
    return F.coalesce(pred, F.lit(False))


def rnd(c: str | Column, places: int = 2) -> Column:
    """Round the binary value (as pandas/NumPy and DuckDB do), not its decimal
    text: ``F.round(1.005, 2)`` gives 1.01 in Spark, this gives 1.0."""
    scale = float(10 ** places)
    # + 0.0 turns a negative zero into zero, as every engine prints it
    return F.round(col(c).cast("double") * scale) / scale + F.lit(0.0)


def money_sum(c: str | Column) -> Column:
    """Exact sum of two-decimal money (order independent), returned as double."""
    return F.sum(col(c).cast("decimal(18,2)")).cast("double")


def as_day(c: str | Column) -> Column:
    return F.to_date(col(c))


def period_bucket(c: str | Column, grain: str) -> Column:
    """First day of the calendar bucket, as a date.

    Group on this (a fixed-width value, cheap to hash) and turn the grouped
    rows into text with ``period_label``: formatting every input row as a
    string costs about as much as the aggregation itself.
    """
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}; use one of {GRAINS}")
    d = F.to_date(col(c))
    return d if grain == "day" else F.trunc(d, grain)


def period_label(bucket: str | Column, grain: str) -> Column:
    """Text of a ``period_bucket`` value, as ``period_key`` prints it.
    Labels sort in the same order as the buckets."""
    b = col(bucket)
    if grain == "day":
        return F.date_format(b, "yyyy-MM-dd")
    if grain == "week":
        return F.concat(F.date_format(b, "yyyy-MM-dd"), F.lit("/"), F.date_format(F.date_add(b, 6), "yyyy-MM-dd"))
    if grain == "month":
        return F.date_format(b, "yyyy-MM")
    if grain == "quarter":
        return F.concat(F.year(b).cast("string"), F.lit("Q"), F.quarter(b).cast("string"))
    if grain == "year":
        return F.year(b).cast("string")
    raise ValueError(f"unknown grain {grain!r}; use one of {GRAINS}")


def period_key(c: str | Column, grain: str) -> Column:
    """Calendar bucket as text, in the form pandas periods print.

    day ``yyyy-MM-dd``; week ``Mon/Sun`` dates joined by ``/``; month
    ``yyyy-MM``; quarter ``yyyyQn``; year ``yyyy``.
    """
    ts = col(c)
    if grain == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if grain == "week":
        start = F.date_trunc("week", ts)
        return F.concat(
            F.date_format(start, "yyyy-MM-dd"),
            F.lit("/"),
            F.date_format(F.date_add(F.to_date(start), 6), "yyyy-MM-dd"),
        )
    if grain == "month":
        return F.date_format(ts, "yyyy-MM")
    if grain == "quarter":
        return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))
    if grain == "year":
        return F.year(ts).cast("string")
    raise ValueError(f"unknown grain {grain!r}; use one of {GRAINS}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN (and +-inf) into NULL for every float column."""
    out = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(field.name)
            out.append(
                F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), F.lit(None))
                .otherwise(c)
                .cast(field.dataType)
                .alias(field.name)
            )
        else:
            out.append(F.col(field.name))
    return df.select(*out)


def safe_name(text: str) -> str:
    import re

    cleaned = re.sub(r"[^0-9a-zA-Z]+", "_", text.strip().lower()).strip("_")
    return cleaned or "column"


def stems_from(name: Column, measure: str) -> Column:
    """Whether a column name is the measure's own or is built on it (``profit`` -> ``profit_band``, ``net_profit``)."""
    low, stem = F.lower(name), measure.lower()
    if not stem:
        return F.lit(False)
    return F.concat(low, F.lit("_")).startswith(f"{stem}_") | F.concat(F.lit("_"), low).endswith(f"_{stem}")
