"""Join discovery and application.

Candidate discovery never joins the tables themselves. Each side's key-like
columns are unpivoted to a value histogram ``(column, key, cnt)`` (one
shuffle, map-side combined), and the two histograms are joined on the key.
A value held by a third of the rows is one histogram row, so discovery is
skew-free; overlap, matched rows, uniqueness and the exact row count a left
join would produce all come from that one join.

Most pairs of columns have nothing in common. Before the join, every left
column's sample of distinct keys (the ``SAMPLE`` smallest hashes) is looked up
in the right histogram. A pair whose overlap cannot reach the threshold is
ruled out: because the right column has too few values, because the sample is
the whole column, or because by Hoeffding's bound an overlap at the threshold
would show so few matches in the sample with a probability below ``RISK``. Only
columns of the pairs that are left go into the join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veritable.functions.exprs import is_numeric_type, with_scalars
from veritable.functions.names import Names

# Fixed values of the join rules.
MIN_OVERLAP = 0.5
MIN_KEY_VALUES = 5
MIN_LOOKUP_VALUES = 2
FAN_OUT_WARNING = 1.05
UNIQUE_BONUS = 0.25
NAME_BONUS = 0.15
NON_KEY_ROLES = ("measure", "datetime", "constant")
#: Distinct keys of a left column that are looked up first, and the probability of ruling out a pair wrongly.
SAMPLE, RISK = 1_024, 1e-18
#: Keys drawn beyond twice the sample: at random hashes, that fewer than the sample are drawn has a chance below 1e-100.
SPARE = 60


def whole_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def key_expr(df: DataFrame, column: str, numeric: bool) -> Column:
    """Key text that is equal exactly for equal numbers of any type (1 == 1.0); other keys are trimmed text.

    A whole number within 64 bits prints as such, any other number as its
    double; nothing is rounded to a common scale.
    """
    c, dtype = F.col(column), df.schema[column].dataType
    if not numeric:
        return F.trim(c.cast("string"))
    if whole_type(dtype):
        return c.cast("bigint").cast("string")
    x = c.cast("double")
    inside = F.when((x >= -(2.0**63)) & (x < 2.0**63), c)
    whole = inside.cast("bigint")
    return F.coalesce(F.when(whole.cast(dtype) == inside, whole.cast("string")), x.cast("string"))


def join_keys(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> tuple[Column, Column]:
    """Both sides' key in a common type: whole numbers as bigint, floats as double, else by ``key_expr``."""
    lt, rt = left.schema[left_col].dataType, right.schema[right_col].dataType
    if whole_type(lt) and whole_type(rt):
        return F.col(left_col).cast("bigint"), F.col(right_col).cast("bigint")
    if all(isinstance(t, (T.FloatType, T.DoubleType)) for t in (lt, rt)):
        return F.col(left_col).cast("double"), F.col(right_col).cast("double")
    numeric = is_numeric_type(lt) and is_numeric_type(rt)
    return key_expr(left, left_col, numeric), key_expr(right, right_col, numeric)


def names_agree(left: str, right: str) -> bool:
    """Whether two columns are spelt alike (no case, blanks or underscores)."""
    return Names([left]).find(right) == left


def key_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, is_numeric, key, cnt) over the given columns, NULL keys kept."""
    parts = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(is_numeric_type(df.schema[c].dataType)).alias("is_numeric"),
            key_expr(df, c, is_numeric_type(df.schema[c].dataType)).alias("key"),
        )
        for c in columns
    ]
    long = df.select(F.explode(F.array(*parts)).alias("s")).select("s.*")
    return long.groupBy("column_name", "is_numeric", "key").agg(F.count(F.lit(1)).alias("cnt"))


def key_columns(df: DataFrame, roles: dict[str, str], distinct: dict[str, int], minimum: int) -> list[str]:
    """Columns that could identify a row elsewhere, by role and number of distinct values."""
    barred = {c for c, role in roles.items() if role in NON_KEY_ROLES}
    return [c for c in df.columns if c not in barred and distinct.get(c, 0) >= minimum]


def key_names(df: DataFrame, roles: dict[str, str]) -> list[str]:
    """Columns whose role lets them be keys and that are worth counting (no free text)."""
    return [c for c in df.columns if roles.get(c) not in (*NON_KEY_ROLES, "text")]


def screen_pairs(lh: DataFrame, rh: DataFrame, overlap: float = MIN_OVERLAP) -> DataFrame:
    """(left_column, right_column, left_distinct, right_distinct, sampled, found, bound, kept) of all pairs of the
    same numeric-ness; ``bound`` is the largest overlap that a pair can still have.

    ``lh`` and ``rh`` are key histograms. At most ``SAMPLE`` keys a left column are sent to all tasks.
    """
    l, r = (h.where("key IS NOT NULL").select("column_name", "is_numeric", "key") for h in (lh, rh))
    count = lambda h, side: h.groupBy(F.col("column_name").alias(f"{side}_column"), F.col("is_numeric").alias(f"{side}_numeric")).agg(
        F.count(F.lit(1)).alias(f"{side}_distinct"))
    # Somewhat more than the sample's share of the hash range first: only these keys are numbered by column, not all of them.
    totals = l.groupBy("column_name").agg((F.lit(2.0 * SAMPLE + SPARE) / F.count(F.lit(1))).alias("_upto"))
    near = l.withColumn("_at", F.xxhash64("key")).join(F.broadcast(totals), "column_name").where(F.col("_at") / F.lit(2.0**64) + 0.5 <= F.col("_upto"))
    first = F.row_number().over(Window.partitionBy("column_name").orderBy("_at", "key"))
    sample = near.withColumn("_n", first).where(F.col("_n") <= SAMPLE).select(
        F.col("column_name").alias("left_column"), F.col("is_numeric").alias("l_numeric"), F.col("key").alias("l_key"))
    hits = r.join(F.broadcast(sample), (F.col("key") == F.col("l_key")) & (F.col("is_numeric") == F.col("l_numeric"))).groupBy(
        "left_column", F.col("column_name").alias("right_column")).agg(F.count(F.lit(1)).alias("found"))
    pairs = count(l, "left").join(count(r, "right"), F.col("left_numeric") == F.col("right_numeric"))
    pairs = pairs.join(hits, ["left_column", "right_column"], "left").withColumn("sampled", F.least(F.lit(SAMPLE), "left_distinct"))
    found, sampled = F.coalesce("found", F.lit(0)), F.col("sampled")
    slack = F.when(sampled == F.col("left_distinct"), 0.0).otherwise(F.sqrt(F.lit(math.log(1 / RISK) / 2) / sampled))
    bound = F.least(found / sampled + slack, F.col("right_distinct") / F.col("left_distinct"))
    return pairs.select("left_column", "right_column", "left_distinct", "right_distinct", "sampled", found.alias("found"), bound.alias("bound"),
                        (bound >= overlap).alias("kept"))


def candidate_stats(left: DataFrame, left_cols: list[str], right: DataFrame, right_cols: list[str],
                    overlap: float | None = None) -> DataFrame:
    """J1-J3 for every pair of columns of the same numeric-ness, in one job.

    Output per (left_column, right_column): overlap, matched_rows,
    expected_rows (rows a left join would give), right_unique, left_rows.
    With ``overlap``, pairs that cannot reach it are left out, and columns
    without another pair take no part in the join.
    """
    lh, rh = key_histogram(left, left_cols), key_histogram(right, right_cols)
    kept = None
    if overlap is not None:  # a row for a pair of columns at most
        kept = screen_pairs(lh, rh, overlap).where("kept").select("left_column", "right_column")
        lh = lh.join(F.broadcast(kept.select(F.col("left_column").alias("column_name")).distinct()), "column_name", "left_semi")
        rh = rh.join(F.broadcast(kept.select(F.col("right_column").alias("column_name")).distinct()), "column_name", "left_semi")
    lh = lh.withColumnRenamed("column_name", "left_column").withColumnRenamed("cnt", "lcnt")
    rh = rh.withColumnRenamed("column_name", "right_column").withColumnRenamed("cnt", "rcnt").withColumnRenamed("is_numeric", "r_numeric")
    # per right column: is it unique among non-null keys?
    r_unique = rh.filter(F.col("key").isNotNull()).groupBy("right_column", "r_numeric").agg(
        (F.max("rcnt") <= 1).alias("right_unique"), F.count(F.lit(1)).alias("right_distinct")
    )
    # per left column: totals and distinct non-null keys
    l_tot = lh.groupBy("left_column", "is_numeric").agg(
        F.sum("lcnt").alias("left_rows"),
        F.count(F.when(F.col("key").isNotNull(), 1)).alias("left_distinct"),
    )
    pairs = l_tot.join(r_unique, l_tot.is_numeric == r_unique.r_numeric)
    if kept is not None:
        pairs = pairs.join(F.broadcast(kept), ["left_column", "right_column"], "left_semi")
    matches = lh.filter(F.col("key").isNotNull()).join(
        rh.filter(F.col("key").isNotNull()),
        (lh.key == rh.key) & (lh.is_numeric == rh.r_numeric),
    ).groupBy("left_column", "right_column").agg(
        F.count(F.lit(1)).alias("matched_distinct"),
        F.sum("lcnt").alias("matched_rows"),
        F.sum(F.col("lcnt") * (F.col("rcnt") - 1)).alias("extra_rows"),
    )
    out = pairs.join(matches, ["left_column", "right_column"], "left")
    return out.select(
        "left_column", "right_column",
        F.when(F.col("left_distinct") > 0, F.coalesce(F.col("matched_distinct"), F.lit(0)) / F.col("left_distinct"))
        .otherwise(0.0).alias("overlap"),
        F.coalesce(F.col("matched_rows"), F.lit(0)).cast("bigint").alias("matched_rows"),
        (F.col("left_rows") + F.coalesce(F.col("extra_rows"), F.lit(0))).cast("bigint").alias("expected_rows"),
        F.col("left_rows").cast("bigint").alias("left_rows"),
        "right_unique",
    )


def find_candidates(
    left: DataFrame, right: DataFrame, left_roles: dict[str, str], right_roles: dict[str, str],
    left_distinct: dict[str, int], right_distinct: dict[str, int],
) -> DataFrame:
    """Scored candidates with overlap >= 0.5, best first.

    score = overlap + 0.25 if the right key is unique + 0.15 if the names agree.
    """
    lcols = key_columns(left, left_roles, left_distinct, MIN_KEY_VALUES)
    rcols = key_columns(right, right_roles, right_distinct, MIN_LOOKUP_VALUES)
    stats = candidate_stats(left, lcols, right, rcols, MIN_OVERLAP).filter(F.col("overlap") >= MIN_OVERLAP)
    agree = F.lit(False)
    for lc in lcols:
        for rc in rcols:
            if names_agree(lc, rc):
                agree = agree | ((F.col("left_column") == lc) & (F.col("right_column") == rc))
    fan_out = F.col("expected_rows") / F.col("left_rows")
    score = F.col("overlap") + F.when(F.col("right_unique"), UNIQUE_BONUS).otherwise(0.0) + \
        F.when(agree, NAME_BONUS).otherwise(0.0)
    return stats.select(
        "*", fan_out.alias("fan_out"),
        (F.col("right_unique") & (fan_out <= FAN_OUT_WARNING)).alias("safe"),
        score.alias("score"),
    ).orderBy(F.col("score").desc(), "left_column", "right_column")


def value_overlap(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    """J1 for one pair."""
    return candidate_stats(left, [left_col], right, [right_col])


def apply_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str,
               broadcast_right: bool = False) -> DataFrame:
    """Left join on canonical keys; colliding right columns are dropped.

    The physical strategy is Catalyst's: a lookup under
    ``spark.sql.autoBroadcastJoinThreshold`` (a size check on plan statistics)
    is broadcast, anything larger is shuffled, and AQE splits a skewed key.
    ``broadcast_right`` is for callers that have proved the right side small.
    """
    left_key, right_key = join_keys(left, left_col, right, right_col)
    own = [c for c in right.columns if c not in left.columns]
    lookup = right.select(right_key.alias("_right_key"), *own)
    if broadcast_right:
        lookup = F.broadcast(lookup)
    keyed = left.select("*", left_key.alias("_left_key"))
    return keyed.join(lookup, keyed["_left_key"] == lookup["_right_key"], "left").select(*left.columns, *own)


def join_report(left: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows before and after a join (one small job each side)."""
    return with_scalars(left.agg(F.count(F.lit(1)).cast("bigint").alias("rows_before")),
                        joined.agg(F.count(F.lit(1)).cast("bigint").alias("rows_after")))


def choose_base(tables: dict[str, DataFrame], roles: dict[str, dict[str, str]]) -> str:
    """The table with most rows, then most measures (one count per table)."""
    def weight(name):
        measures = sum(1 for r in roles.get(name, {}).values() if r == "measure")
        return (tables[name].count(), measures)

    return max(tables, key=weight)


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact distinct non-null counts from one histogram job (bounded result)."""
    h = key_histogram(df, columns).filter(F.col("key").isNotNull())
    return {r["column_name"]: r["n"] for r in h.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
