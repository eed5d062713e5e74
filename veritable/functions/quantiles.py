"""Exact global quantiles with bounded memory.

``percentile`` keeps a map of every distinct value in the final task, which
does not survive a high-cardinality column at cluster scale. Here a quantile
sketch (``percentile_approx``: bounded memory, distributed) brackets each
needed order statistic; one conditional count gives the rank of every
bracket's lower edge; only the rows inside the brackets - a few per ten
thousand of the column by the sketch's rank guarantee - are read to pick the
exact values from the bracket's (value, count) histogram. A bracket holding
more than ``max_rows`` distinct values is narrowed again on its own rows; one
that misses (ties can crowd it) is widened. All columns and probabilities
share the same three jobs (sketch, counts, bracket histograms).

The result equals linear interpolation between order statistics (pandas
``quantile``, DuckDB ``quantile_cont``, Spark ``percentile``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10000
# A bracket is narrowed on its own rows until it has at most this many distinct values; these reach the driver.
MAX_BRACKET_ROWS = 2_048


def _vals(df: DataFrame, column: str):
    return F.col(column).try_cast("double")


def _bracket_hist(df: DataFrame, brackets: list[tuple[str, float, float]], ids: list[int]) -> DataFrame:
    """(k, v, count): the distinct values inside each chosen bracket with
    their counts (ties collapse to one entry; partial aggregation per task)."""
    inside = {j: (_vals(df, brackets[j][0]) >= F.lit(brackets[j][1])) & (_vals(df, brackets[j][0]) <= F.lit(brackets[j][2]))
              for j in ids}
    parts = [F.when(inside[j], F.struct(F.lit(j).alias("k"), _vals(df, brackets[j][0]).alias("v"))) for j in ids]
    # the range filter first: only bracket rows reach the explode (and the
    # scan can skip row groups by their min/max)
    any_inside = inside[ids[0]]
    for j in ids[1:]:
        any_inside = any_inside | inside[j]
    return (df.filter(any_inside).select(F.explode(F.array_compact(F.array(*parts))).alias("s"))
            .groupBy("s.k", "s.v").count())


def _order_stats(df: DataFrame, wanted: dict[str, list[int]], counts: dict[str, int], accuracy: int,
                 max_rows: int) -> dict[tuple[str, int], float]:
    """Exact values at 0-based ascending ranks, per column."""
    out: dict[tuple[str, int], float] = {}
    pending = [(c, r) for c, ranks in wanted.items() for r in sorted(set(ranks))]
    eps = 2.0 / accuracy
    while pending:
        # one sketch per column, holding every probability that column needs
        by_col: dict[str, list[int]] = {}
        for i, (c, r) in enumerate(pending):
            by_col.setdefault(c, []).append(i)
        sketch = []
        for j, (c, idx) in enumerate(by_col.items()):
            n = counts[c]
            probs = []
            for i in idx:
                p = pending[i][1] / max(n - 1, 1)
                probs += [max(0.0, p - eps), min(1.0, p + eps)]
            sketch.append(F.percentile_approx(_vals(df, c), probs, accuracy).alias(f"e{j}"))
        edges = df.agg(*sketch).first()
        # neighbouring ranks (the two sides of an interpolation) usually share
        # a bracket: each distinct (column, lo, hi) is counted and read once
        ids: dict[tuple[str, float, float], int] = {}
        bracket_of: list[int] = [0] * len(pending)
        for j, (c, idx) in enumerate(by_col.items()):
            e = edges[f"e{j}"]
            for k, i in enumerate(idx):
                bracket_of[i] = ids.setdefault((c, e[2 * k], e[2 * k + 1]), len(ids))
        brackets = list(ids)
        aggs = []
        for j, (c, lo, hi) in enumerate(brackets):
            x = _vals(df, c)
            aggs += [F.count_if(x < F.lit(lo)).alias(f"b{j}"), F.count_if((x >= F.lit(lo)) & (x <= F.lit(hi))).alias(f"i{j}")]
        cnt = df.agg(*aggs).first()
        retry: list[tuple[str, int]] = []
        need: dict[int, list[int]] = {}
        for i, (c, r) in enumerate(pending):
            j = bracket_of[i]
            below, inside = cnt[f"b{j}"], cnt[f"i{j}"]
            _c, lo, hi = brackets[j]
            if not (below <= r < below + inside):
                retry.append((c, r))                   # ties moved the rank out: widen
            elif lo == hi:
                out[(c, r)] = float(lo)               # every row in the bracket holds this value
            else:
                need.setdefault(j, []).append(r)
        if need:
            # a bracket with at most max_rows rows has at most that many
            # distinct values: read its histogram directly. Only a crowded one
            # needs its distinct count, to be read or narrowed on its own rows.
            read = [j for j in need if cnt[f"i{j}"] <= max_rows]
            crowded = [j for j in need if j not in read]
            if crowded:
                sizes = {row["k"]: row["count"] for row in _bracket_hist(df, brackets, crowded).groupBy("k").count().collect()}
                read += [j for j in crowded if sizes.get(j, 0) <= max_rows]
            by_k: dict[int, list[tuple[float, int]]] = {}
            if read:
                for row in _bracket_hist(df, brackets, read).collect():
                    by_k.setdefault(row["k"], []).append((row["v"], row["count"]))
            for j, ranks in need.items():
                c, lo, hi = brackets[j]
                below = cnt[f"b{j}"]
                if j in by_k:
                    hist = sorted(by_k[j])
                    for r in ranks:
                        seen = below
                        for v, n in hist:
                            seen += n
                            if r < seen:
                                out[(c, r)] = float(v)
                                break
                else:
                    sub = df.filter((_vals(df, c) >= F.lit(lo)) & (_vals(df, c) <= F.lit(hi)))
                    got = _order_stats(sub, {c: [r - below for r in ranks]}, {c: cnt[f"i{j}"]}, accuracy, max_rows)
                    for r in ranks:
                        out[(c, r)] = got[(c, r - below)]
        pending = retry
        eps = min(eps * 4, 1.0)
    return out


def exact_quantiles_many(df: DataFrame, probs: dict[str, list[float]], accuracy: int = SKETCH_ACCURACY,
                         max_rows: int = MAX_BRACKET_ROWS, counts: dict[str, int] | None = None
                         ) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of the non-null values of several columns."""
    cols = list(probs)
    if counts is None:
        row = df.agg(*[F.count(_vals(df, c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
        counts = {c: int(row[f"n{i}"]) for i, c in enumerate(cols)}
    wanted: dict[str, list[int]] = {}
    for c in cols:
        n = counts[c]
        if n == 0:
            continue
        for p in probs[c]:
            lo = int(math.floor((n - 1) * p))
            wanted.setdefault(c, []).extend([lo, min(lo + 1, n - 1)])
    stats = _order_stats(df, wanted, counts, accuracy, max_rows) if wanted else {}
    out: dict[str, list[float | None]] = {}
    for c in cols:
        n = counts[c]
        res = []
        for p in probs[c]:
            if n == 0:
                res.append(None)
                continue
            h = (n - 1) * p
            lo = int(math.floor(h))
            a, b = stats[(c, lo)], stats[(c, min(lo + 1, n - 1))]
            res.append(a + (h - lo) * (b - a))
        out[c] = res
    return out


def exact_quantiles(df: DataFrame, column: str, probs: list[float], accuracy: int = SKETCH_ACCURACY,
                    max_rows: int = MAX_BRACKET_ROWS) -> list[float | None]:
    return exact_quantiles_many(df, {column: probs}, accuracy, max_rows)[column]


def global_quantiles(df: DataFrame, probs: dict[str, list[float]], counts: dict[str, int] | None = None
                     ) -> dict[str, list[float | None]]:
    """Exact quantiles per column: one method and one interpolation at every size and cardinality."""
    return exact_quantiles_many(df, probs, counts=counts)


def quantile_literal(df: DataFrame, column: str, probs: list[float] | float):
    """Exact global quantile(s) of a column as a literal for a later
    aggregation: one value for a float ``probs``, an array for a list.

    Used wherever a whole-table median or quantile sits beside other
    aggregates: an exact ``percentile`` there would merge a map of every
    distinct value into one task.
    """
    many = isinstance(probs, list)
    vals = global_quantiles(df, {column: list(probs) if many else [probs]})[column]
    if many:
        if vals[0] is None:
            return F.lit(None).cast("array<double>")
        return F.array(*[F.lit(float(v)) for v in vals])
    return F.lit(vals[0]).cast("double")


def grouped_quantile(df: DataFrame, keys: list[str], value: str, p: float, accuracy: int = SKETCH_ACCURACY
                     ) -> DataFrame:
    """Exact linear-interpolated quantile ``p`` of ``value`` per group:
    (keys..., ``_q``). Rows with a NULL key are ignored; NULL values are
    skipped (a group with no value gets NULL).

    ``percentile`` per group would merge a map of the group's distinct
    values into one task; a group holding a third of the rows makes that map
    as large as the data. Here each group's sketch (``percentile_approx``,
    merged from per-task partials) brackets its order statistics; one
    aggregation, partially combined in every task, gives the group's count
    below the bracket and the bracket's (value, count) histogram; a running
    count per group over that histogram names the two order statistics.
    Only bracket rows reach the per-group window, so a hot group contributes
    about 4/accuracy of its rows there (ties collapse). A group whose
    statistics fall outside its bracket (the sketch missed) is computed with
    ``percentile`` on its own.
    """
    from pyspark.sql import Window as W

    eps = 2.0 / accuracy
    keyed = df.select(*keys, _vals(df, value).alias("_v"))
    for k in keys:
        keyed = keyed.filter(F.col(k).isNotNull())
    base = keyed.filter(F.col("_v").isNotNull())
    h = (F.col("_n") - 1) * F.lit(float(p))
    # every group with a row, also one whose values are all NULL (its
    # quantile is NULL, as ``percentile`` gives)
    groups = (keyed.groupBy(*keys).agg(F.count("_v").alias("_n"),
                                      F.percentile_approx("_v", [max(0.0, p - eps), min(1.0, p + eps)], accuracy).alias("_e"))
              .select(*keys, "_n", F.col("_e")[0].alias("_lo"), F.col("_e")[1].alias("_hi"),
                      F.floor(h).cast("long").alias("_r"), (h - F.floor(h)).alias("_f")))
    j = base.join(groups.select(*keys, "_lo", "_hi"), keys)
    # rows below the bracket collapse to one entry per group (value NULL);
    # rows above it are not needed
    below = F.col("_v") < F.col("_lo")
    hist = (j.filter(F.col("_v") <= F.col("_hi"))
            .select(*keys, F.when(~below, F.col("_v")).alias("_b"))
            .groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c")))
    w = W.partitionBy(*keys).orderBy(F.col("_b").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = hist.select(*keys, "_b", "_c", F.sum("_c").over(w).alias("_cum"))
    ranked = ranked.join(groups, keys)
    r1 = F.least(F.col("_r") + 1, F.col("_n") - 1)
    first = (F.col("_cum") - F.col("_c"))          # rank of the entry's first copy
    picked = ranked.filter(F.col("_b").isNotNull()).groupBy(*keys).agg(
        F.first("_n").alias("_n"), F.first("_f").alias("_f"),
        F.max(F.when((first <= F.col("_r")) & (F.col("_r") < F.col("_cum")), F.col("_b"))).alias("_a"),
        F.max(F.when((first <= r1) & (r1 < F.col("_cum")), F.col("_b"))).alias("_z"))
    found = picked.filter(F.col("_a").isNotNull() & F.col("_z").isNotNull()).select(
        *keys, (F.col("_a") + F.col("_f") * (F.col("_z") - F.col("_a"))).alias("_q"))
    missed = groups.select(*keys).join(found.select(*keys), keys, "left_anti")
    fallback = (base.join(missed, keys).groupBy(*keys).agg(F.percentile("_v", float(p)).alias("_q")))
    return groups.select(*keys).join(found.unionByName(fallback), keys, "left")
