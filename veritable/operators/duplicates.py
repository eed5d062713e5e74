"""Duplicate detection and removal.

All three are grouped aggregations with map-side combine, so a key holding a
third of the rows is reduced inside every map task before the shuffle (whole
wide rows are counted by fingerprint before they are compared); no operator sorts or collects a whole group. "First" is defined by an explicit
ordering (``min_by`` over a struct), never by physical row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_fingerprint(columns: list[str]) -> Column:
    """128 bits of a row: two hashes over its columns, with different beginnings."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("other"), *reversed(columns)).alias("b"))


def duplicate_groups(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Repeated keys and their ``_copies``. Whole rows meet by fingerprint first: 16 bytes a row are counted, and only
    rows whose fingerprint is there twice are compared column by column."""
    keys = subset or df.columns
    if not subset and len(keys) > 1:
        mark = free_name("_fingerprint", df.columns)
        marked = df.withColumn(mark, row_fingerprint(keys))
        twice = marked.groupBy(mark).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(mark).alias("_twice"))
        df = marked.join(twice, F.col(mark) == F.col("_twice"), "left_semi").drop(mark)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")).filter(F.col("_copies") > 1)


def free_name(base: str, taken: list[str]) -> str:
    while base.lower() in {t.lower() for t in taken}:
        base += "_"
    return base


def find_duplicates(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Extra copies beyond the first and number of repeated groups (nulls equal)."""
    g = duplicate_groups(df, subset)
    return g.agg(
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).cast("bigint").alias("extra_copies"),
        F.count(F.lit(1)).cast("bigint").alias("repeated_groups"),
        F.coalesce(F.sum("_copies"), F.lit(0)).cast("bigint").alias("rows_involved"),
    )


def duplicate_examples(df: DataFrame, subset: list[str] | None = None, n: int = 12) -> DataFrame:
    """Up to ``n`` rows that belong to a repeated group (a bounded report)."""
    keys = subset or df.columns
    g = duplicate_groups(df, keys).drop("_copies")
    return df.join(g, on=[df[k].eqNullSafe(g[k]) for k in keys], how="left_semi").orderBy(*keys).limit(n)


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Keep the first row per key.

    Whole-row duplicates need no order. For a key subset, ``order_by`` says
    which row is first (ascending, NULLs first); default: all other columns.
    """
    if not subset:
        return df.dropDuplicates()
    others = [c for c in df.columns if c not in subset]
    order = order_by or others
    if not others:
        return df.dropDuplicates(subset)
    pick = F.min_by(F.struct(*[F.col(c) for c in others]), F.struct(*[F.col(c) for c in order]))
    kept = df.groupBy(*subset).agg(pick.alias("_first"))
    return kept.select(*[F.col(c) if c in subset else F.col(f"_first.{c}").alias(c) for c in df.columns])


def merge_duplicates(
    df: DataFrame,
    measures: list[str],
    subset: list[str] | None = None,
    order_by: list[str] | None = None,
) -> DataFrame:
    """D3: one row per key, measures summed, other columns from the first row.

    Keys default to every non-measure column; NULL keys form their own group.
    With no keys or no measures this falls back to D2.
    """
    measures = [m for m in measures if m in df.columns]
    keys = [k for k in (subset or [c for c in df.columns if c not in measures]) if k in df.columns]
    if not keys or not measures:
        return drop_duplicates(df, subset, order_by)
    rest = [c for c in df.columns if c not in keys and c not in measures]
    order = order_by or [c for c in df.columns if c not in keys]
    # sums keep the type Spark gives them: a total may pass the measure's own range
    aggs = [F.coalesce(F.sum(F.col(m)), F.lit(0)).alias(m) for m in measures]
    if rest:
        aggs.append(F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])).alias("_first"))
    merged = df.groupBy(*keys).agg(*aggs)
    return merged.select(*[
        F.col(f"_first.{c}").alias(c) if c in rest else F.col(c) for c in df.columns
    ])
