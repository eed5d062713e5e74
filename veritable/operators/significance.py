"""Group comparisons with an honest verdict.

Group statistics are one grouped aggregate (n, mean, sample variance) with
map-side combine. The normal interval and the fast path decide most
comparisons in expressions; only undecided ones run the bootstrap: a bag of
little bootstraps over the histogram of the two groups' values
(``functions/resampling.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.functions.exprs import num, with_scalars
from veritable.functions.resampling import mean_difference_interval

# Fixed values of the comparison rules.
RESAMPLES = 2000
CONFIDENCE = 0.95
MIN_GROUP_ROWS = 20
MIN_RELATIVE_GAP = 0.05
FAST_PATH_ROWS = 200
FAST_PATH_WIDTH = 0.8
Z95 = 1.96
SEED = 12345


def group_stats(df: DataFrame, group: str, measure: str) -> DataFrame:
    """(group, n, mean, var) over non-null values; group compared as text."""
    x = num(measure)
    return (df.select(F.col(group).cast("string").alias("group"), x.alias("_v"))
            .filter(F.col("group").isNotNull() & F.col("_v").isNotNull())
            .groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"),
                                  F.coalesce(F.var_samp("_v"), F.lit(0.0)).alias("var")))


def _pair(stats: DataFrame, left: str | Column, right: str | Column) -> DataFrame:
    l = stats.select(F.col("group").alias("left"), F.col("n").alias("n_left"), F.col("mean").alias("mean_left"),
                     F.col("var").alias("var_left"))
    r = stats.select(F.col("group").alias("right"), F.col("n").alias("n_right"), F.col("mean").alias("mean_right"),
                     F.col("var").alias("var_right"))
    lcond = F.col("left") == (F.lit(left) if isinstance(left, str) else left)
    rcond = F.col("right") == (F.lit(right) if isinstance(right, str) else right)
    # the right group's one row rides along as scalars; a missing group gives no row
    return with_scalars(l.filter(lcond), r.filter(rcond)).filter(F.col("right").isNotNull())


def verdict_columns(pair: DataFrame) -> DataFrame:
    """G1-G3 on a one-row pair: difference, relative gap, normal interval,
    verdict (too_few / noise / solid) or ``undecided`` for the bootstrap."""
    diff = F.col("mean_left") - F.col("mean_right")
    base = F.when(F.col("mean_right") != 0, F.abs("mean_right")).otherwise(F.abs("mean_left"))
    rel = F.when(base != 0, diff / base).otherwise(0.0)
    se = F.sqrt(F.col("var_left") / F.col("n_left") + F.col("var_right") / F.col("n_right"))
    lo, hi = diff - Z95 * se, diff + Z95 * se
    too_few = (F.col("n_left") < MIN_GROUP_ROWS) | (F.col("n_right") < MIN_GROUP_ROWS)
    fast = ((F.least("n_left", "n_right") >= FAST_PATH_ROWS) & ((lo > 0) | (hi < 0))
            & ((hi - lo) <= F.abs(diff) * FAST_PATH_WIDTH))
    verdict = (F.when(too_few, "too_few").when(F.abs(rel) < MIN_RELATIVE_GAP, "noise")
               .when(fast, "solid").otherwise("undecided"))
    return pair.select(
        "left", "right", "mean_left", "mean_right", F.col("n_left").cast("bigint").alias("n_left"),
        F.col("n_right").cast("bigint").alias("n_right"), diff.alias("difference"), rel.alias("relative"),
        F.when(~too_few, lo).alias("low"), F.when(~too_few, hi).alias("high"), verdict.alias("verdict"),
    )


def compare_groups(df: DataFrame, group: str, measure: str, left: str, right: str,
                   method: str = "bootstrap") -> DataFrame:
    """G1: one row comparing two groups; undecided pairs take ``method``."""
    stats = group_stats(df, group, measure)
    decided = verdict_columns(_pair(stats, left, right))
    return resolve_with_bootstrap(df, group, measure, decided, method)


def compare_extremes(df: DataFrame, group: str, measure: str, how: str = "mean",
                     method: str = "bootstrap") -> DataFrame:
    """Top group vs bottom group by the aggregate (ties: label order)."""
    x = num(measure)
    vals = (df.select(F.col(group).cast("string").alias("group"), x.alias("_v"))
            .filter(F.col("group").isNotNull() & F.col("_v").isNotNull()))
    ranking = {"sum": F.sum, "max": F.max, "min": F.min}.get(how, F.avg)("_v")
    stats = vals.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"),
                                      F.coalesce(F.var_samp("_v"), F.lit(0.0)).alias("var"), ranking.alias("agg"))
    if how == "median":
        from veritable.functions.quantiles import grouped_quantile

        middle = grouped_quantile(vals, ["group"], "_v", 0.5).select("group", F.col("_q").alias("agg"))
        stats = stats.drop("agg").join(middle, "group")
    # both ends with their statistics come out of the one grouped table in one row
    one, order = F.struct("group", "n", "mean", "var"), F.struct(-F.col("agg"), F.col("group"))
    ends = stats.agg(F.count(F.lit(1)).alias("_k"), F.min_by(one, order).alias("t"), F.max_by(one, order).alias("b"))
    pair = ends.filter(F.col("_k") >= 2).select(
        F.col("t.group").alias("left"), F.col("t.n").alias("n_left"), F.col("t.mean").alias("mean_left"),
        F.col("t.var").alias("var_left"), F.col("b.group").alias("right"), F.col("b.n").alias("n_right"),
        F.col("b.mean").alias("mean_right"), F.col("b.var").alias("var_right"))
    decided = verdict_columns(pair)
    return resolve_with_bootstrap(df, group, measure, decided, method)


def bootstrap_interval(df: DataFrame, group: str, measure: str, left: str, right: str, sizes: tuple[int, int] | None = None,
                       resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """95% percentile interval of mean(left) - mean(right), by a bag of little bootstraps.

    ``sizes``: the groups' rows, if they are known; else they are counted.
    """
    rows = df.select(F.col(group).cast("string").alias("_g"), num(measure).cast("double").alias("value"))
    rows = rows.filter(F.col("_g").isin(left, right) & F.col("value").isNotNull())
    rows = rows.select(F.when(F.col("_g") == left, 0).otherwise(1).alias("side"), "value")
    if sizes is None:
        n = rows.agg(F.count_if(F.col("side") == 0), F.count_if(F.col("side") == 1)).first()
        sizes = (n[0], n[1])
    ends = mean_difference_interval(rows, sizes, resamples, CONFIDENCE, seed)
    return ends.select(F.col("low").alias("boot_low"), F.col("high").alias("boot_high"))


def resolve_with_bootstrap(df: DataFrame, group: str, measure: str, decided: DataFrame,
                           method: str = "bootstrap") -> DataFrame:
    """Replace ``undecided`` by the verdict on an interval (noise if it holds
    zero, solid if narrower than the gap, else weak).

    ``method`` names the interval, at every size of the groups: ``bootstrap``
    (its job runs only when a pair is undecided; one row is read to know) or
    ``normal``, which needs no further pass over the rows.
    """
    if method not in ("bootstrap", "normal"):
        raise ValueError(f"unknown method {method!r}")
    row = decided.first()
    if row is None or row["verdict"] != "undecided":
        return decided.withColumn("method", F.when(F.col("verdict") == "too_few", F.lit(None).cast("string"))
                                  .otherwise(F.lit("normal")))
    if method == "normal":
        straddles = (F.col("low") <= 0) & (F.col("high") >= 0)
        verdict = (F.when(straddles, "noise").when((F.col("high") - F.col("low")) <= F.abs("difference"), "solid")
                   .otherwise("weak"))
        return decided.withColumn("verdict", verdict).withColumn("method", F.lit("normal"))
    boot = bootstrap_interval(df, group, measure, row["left"], row["right"], (row["n_left"], row["n_right"]))
    j = with_scalars(decided, boot)
    straddles = (F.col("boot_low") <= 0) & (F.col("boot_high") >= 0)
    verdict = (F.when(straddles | (F.abs("relative") < MIN_RELATIVE_GAP), "noise")
               .when((F.col("boot_high") - F.col("boot_low")) <= F.abs("difference"), "solid").otherwise("weak"))
    return j.select("left", "right", "mean_left", "mean_right", "n_left", "n_right", "difference", "relative",
                    F.col("boot_low").alias("low"), F.col("boot_high").alias("high"), verdict.alias("verdict"),
                    F.lit("bootstrap").alias("method"))


def wilson_interval(count: Column, total: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """Share with a Wilson interval clamped to [0, 1]."""
    p = count / total
    denom = 1 + z * z / total
    centre = (p + z * z / (2 * total)) / denom
    spread = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / denom
    return p, F.greatest(F.lit(0.0), centre - spread), F.least(F.lit(1.0), centre + spread)


def share_by_group(df: DataFrame, group: str, flag: Column) -> DataFrame:
    """G6 for every group at once: share of rows where ``flag`` holds."""
    g = df.select(F.col(group).alias("group"), F.coalesce(flag, F.lit(False)).alias("_f")).groupBy("group").agg(
        F.count_if("_f").alias("count"), F.count(F.lit(1)).alias("total"))
    p, lo, hi = wilson_interval(F.col("count"), F.col("total"))
    return g.select("group", F.col("count").cast("bigint").alias("count"), F.col("total").cast("bigint").alias("total"),
                    p.alias("share"), lo.alias("low"), hi.alias("high"))


def enough_rows(df: DataFrame, group: str, minimum: int = MIN_GROUP_ROWS) -> DataFrame:
    """At least two groups and every group with >= ``minimum`` rows."""
    g = df.filter(F.col(group).isNotNull()).groupBy(group).count()
    return g.agg(((F.count(F.lit(1)) >= 2) & (F.coalesce(F.min("count"), F.lit(0)) >= minimum)).alias("enough"),
                 F.count(F.lit(1)).cast("bigint").alias("groups"), F.min("count").cast("bigint").alias("smallest"))
