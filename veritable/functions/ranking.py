"""Exact order statistics without a global sort or a single-task window.

``near_ranks`` finds the rows at given positions of an order.

``sum_of_top`` finds the exact sum of the k largest values of a column. A
quantile sketch (bounded memory, distributed) brackets the k-th largest value;
everything above the bracket is summed by a distributed aggregate, and only
the rows inside the bracket - a few per ten thousand of the column, by the
sketch's rank guarantee - are ordered to take the remainder. If a bracket ever
misses (it cannot by the guarantee, but ties can crowd it) it widens and
retries; the last resort is the full column range, which is still exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritable.functions.exprs import with_scalars

SKETCH_ACCURACY = 10000

#: Values that cut a column into ranges.
CUTS = 16_383


def sum_of_top(df: DataFrame, column: str, k: int, n: int | None = None) -> float:
    """Exact sum of the ``k`` largest non-null values of ``column``."""
    x = F.col(column)
    values = df.select(x.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if n is None:
        n = values.count()
    if k <= 0 or n == 0:
        return 0.0
    if k >= n:
        return float(values.agg(F.sum("_v")).first()[0] or 0.0)
    p = 1.0 - k / n
    eps = 2.0 / SKETCH_ACCURACY
    while True:
        lo_p, hi_p = max(0.0, p - eps), min(1.0, p + eps)
        if lo_p == 0.0 and hi_p == 1.0:
            bounds = values.agg(F.min("_v"), F.max("_v")).first()
        else:
            bounds = values.agg(
                F.percentile_approx("_v", [lo_p, hi_p], SKETCH_ACCURACY).alias("b")
            ).first()[0]
        lo, hi = float(bounds[0]), float(bounds[1])
        stats = values.agg(
            F.count_if(F.col("_v") > hi).alias("above"),
            F.coalesce(F.sum(F.when(F.col("_v") > hi, F.col("_v"))), F.lit(0.0)).alias("above_sum"),
            F.count_if((F.col("_v") >= lo) & (F.col("_v") <= hi)).alias("inside"),
        ).first()
        above, inside = int(stats["above"]), int(stats["inside"])
        if above <= k <= above + inside:
            rest = k - above
            if rest == 0:
                return float(stats["above_sum"])
            top_inside = (
                values.filter((F.col("_v") >= lo) & (F.col("_v") <= hi))
                .orderBy(F.col("_v").desc())
                .limit(rest)
                .agg(F.sum("_v"))
                .first()[0]
            )
            return float(stats["above_sum"]) + float(top_inside or 0.0)
        eps *= 4


def near_ranks(df: DataFrame, column: str, positions: list[int]) -> DataFrame:
    """The rows of ``df`` about some 0-based positions in the order of ``column`` (distinct, not null), with ``_rank``.

    Every row at one of ``positions`` is among them. A sample of at most
    ``CUTS`` values, drawn by their hash, cuts the column into ranges; the
    counts of the ranges tell which of them hold a position, and only the rows
    of these are ordered, each range by itself. Nothing else is sorted, and
    the tables of ranges have at most ``CUTS + 1`` rows.
    """
    x = F.col(column)
    sample = df.select(x.alias("_x")).orderBy(F.xxhash64("_x"), "_x").limit(CUTS)
    cuts = sample.agg(F.array_sort(F.collect_list("_x")).alias("_cuts"))
    # the number of cuts up to the value, by halving
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(CUTS.bit_length()))])
    placed = with_scalars(df, cuts).withColumn("_range", F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get("_cuts", at + step - 1) <= x, at + step).otherwise(at))).drop("_cuts")
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    wanted = F.array(*[F.lit(p).cast("bigint") for p in positions])
    held = counts.where(F.exists(wanted, lambda p: p.between(F.col("_before") - 1, F.col("_before") + F.col("_n"))))
    own = Window.partitionBy("_range").orderBy(column)
    return placed.join(F.broadcast(held.select("_range", "_before")), "_range").select(
        *df.columns, (F.col("_before") + F.row_number().over(own) - 1).alias("_rank"))
