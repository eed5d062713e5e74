"""Text-to-timestamp parsing over a fixed list of formats (R2).

pandas parses "mixed" formats value by value; Spark needs a closed list. The
list below covers ISO dates and times, slash and dot forms, and month names.

Whether 03/04/2024 is in March or April is decided by its column: a value whose
first number is above 12 contradicts month-first, one whose second number is
above 12 contradicts day-first, and the order that fewer values contradict is
the column's (month-first if both have as many, or ``dayfirst`` says otherwise).
A value that contradicts its column's order is read in the other one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.functions.exprs import col, is_time_type

# Month and day words that parse as dates but are labels.
MONTH_AND_DAY_WORDS = (
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept",
    "oct", "nov", "dec",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday",
    "sunday", "mon", "tue", "tues", "wed", "thu", "thur", "thurs", "fri",
    "sat", "sun",
    "q1", "q2", "q3", "q4",
)

ISO_FORMATS = (
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "yyyyMMdd HH:mm:ss",
)
MONTH_FIRST = ("M/d/yyyy H:mm", "M/d/yyyy", "M-d-yyyy", "M/d/yy")
DAY_FIRST = ("d/M/yyyy H:mm", "d/M/yyyy", "d.M.yyyy", "d-M-yyyy", "d/M/yy")
WORDY = ("d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM yyyy", "MMMM yyyy")


def datetime_formats(dayfirst: bool = False) -> tuple[str, ...]:
    order = DAY_FIRST + MONTH_FIRST if dayfirst else MONTH_FIRST + DAY_FIRST
    return ISO_FORMATS + order + WORDY


def parse_datetime(c, dayfirst: bool = False) -> Column:
    """First format that parses wins; text that parses under none is NULL."""
    text = F.trim(col(c).cast("string"))
    attempts = [F.try_to_timestamp(text, F.lit(fmt)) for fmt in datetime_formats(dayfirst)]
    return F.coalesce(*attempts)


def _numbers(c) -> tuple[Column, Column]:
    """The first two numbers of a date of numbers with slashes or dashes and the year at its end, else NULL."""
    form = r"^(\d{1,2})[/-](\d{1,2})[/-](?:\d{4}|\d{2})(?:\D|$)"
    text = F.trim(col(c).cast("string"))
    return tuple(F.regexp_extract(text, form, k).try_cast("int") for k in (1, 2))


def order_votes(c) -> tuple[Column, Column]:
    """Aggregates: values that contradict month-first, and those that contradict day-first."""
    a, b = _numbers(c)
    return F.count_if(a.between(13, 31) & b.between(1, 12)), F.count_if(b.between(13, 31) & a.between(1, 12))


def date_orders(df: DataFrame, columns: list[str], dayfirst: bool = False) -> DataFrame:
    """R2: (column_name, against_month_first, against_day_first, day_first) of text columns, from one aggregate."""
    votes = [v.alias(f"{k}{i}") for i, c in enumerate(columns) for k, v in zip("md", order_votes(c), strict=True)]
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("against_month_first"), F.col(f"d{i}").alias("against_day_first"))
            for i, c in enumerate(columns)]
    long = df.agg(*votes).select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    m, d = F.col("against_month_first"), F.col("against_day_first")
    return long.withColumn("day_first", (m >= d) if dayfirst else (m > d))


def time_column(df: DataFrame, column: str, dayfirst: bool = False) -> Column:
    """A column as a time: as it is, or text parsed in the order that the whole column decides.

    The order is a scalar subquery: one aggregate over the column, when and if
    the result is computed.
    """
    if is_time_type(df.schema[column].dataType):
        return F.col(column)
    order = date_orders(df.select(F.col(column).cast("string").alias("_text")), ["_text"], dayfirst).select("day_first").scalar()
    return F.when(order, parse_datetime(column, True)).otherwise(parse_datetime(column, False))


def bare_number_flag(c) -> Column:
    return F.trim(col(c).cast("string")).rlike(r"^\d+(\.\d+)?$")


def calendar_word_flag(c) -> Column:
    return F.lower(F.trim(col(c).cast("string"))).isin(*MONTH_AND_DAY_WORDS)
