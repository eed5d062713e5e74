"""Chart-table queries (A8-A13, C1-C10) on lineitem, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritable.functions.exprs import rnd
from veritable.operators import charts as CH
from veritable.operators import features as FT
from veritable.queries.registry import register
from veritable.sources.tables import load


def _bar_out(df):
    return df.select(F.col("group").alias("label"), rnd("value", 2).alias("value"), F.col("position").cast("int").alias("position"))


TREND_SQL = """(SELECT strftime(l_shipdate, '%Y-%m') AS period, sum(l_extendedprice) AS value FROM lineitem
  WHERE l_shipdate IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1)"""


@register("chart_trend", f"""
SELECT period, round(value, 2) AS value FROM {TREND_SQL} WHERE (SELECT count(*) FROM {TREND_SQL}) >= 4
""")
def chart_trend(spark, sf_dir):
    t = CH.trend(load(spark, sf_dir, "lineitem"), "l_shipdate", "l_extendedprice")
    return t.select("period", rnd("value", 2).alias("value"))


@register("chart_trend_facts", f"""
WITH t AS {TREND_SQL},
g AS (SELECT min(period) AS first_period, max(period) AS last_period, arg_min(value, period) AS f,
             arg_max(value, period) AS l, max(value) AS peak_value FROM t),
p AS (SELECT period AS peak_period FROM t ORDER BY value DESC, period LIMIT 1)
SELECT first_period, last_period, round(f, 2) AS first, round(l, 2) AS last,
       round(CASE WHEN f <> 0 THEN (l - f) / f * 100 ELSE 0 END, 4) AS change_pct,
       CASE WHEN (CASE WHEN f <> 0 THEN (l - f) / f * 100 ELSE 0 END) > 2 THEN 'grew'
            WHEN (CASE WHEN f <> 0 THEN (l - f) / f * 100 ELSE 0 END) < -2 THEN 'fell' ELSE 'stayed flat' END AS direction,
       peak_period, round(peak_value, 2) AS peak_value
FROM g, p
""")
def chart_trend_facts(spark, sf_dir):
    f = CH.trend_facts(CH.trend(load(spark, sf_dir, "lineitem"), "l_shipdate", "l_extendedprice"))
    return f.select("first_period", "last_period", rnd("first", 2).alias("first"), rnd("last", 2).alias("last"),
                    rnd("change_pct", 4).alias("change_pct"), "direction", "peak_period",
                    rnd("peak_value", 2).alias("peak_value"))


def _fold_sql(grouped: str, limit: int, additive: bool = True) -> str:
    other = "" if not additive else f"""
UNION ALL SELECT 'Other', round(sum(value), 2), {limit} FROM r WHERE position >= {limit}
  HAVING (SELECT count(*) FROM g) > {limit}"""
    keep = f"position < {limit} OR (SELECT count(*) FROM g) <= {limit}" if additive else f"position <= {limit}"
    return f"""
WITH g AS ({grouped}),
r AS (SELECT label, value, row_number() OVER (ORDER BY value DESC NULLS LAST, label) AS position FROM g)
SELECT label, round(value, 2) AS value, CAST(position AS INTEGER) AS position FROM r
WHERE ({keep}) AND (SELECT count(*) FROM g) >= 2{other}
"""


@register("chart_bar_other", _fold_sql(
    "SELECT coalesce(CAST(l_suppkey AS VARCHAR), '(empty)') AS label, sum(l_extendedprice) AS value "
    "FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1", 8))
def chart_bar_other(spark, sf_dir):
    return _bar_out(CH.category_bar(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", "sum"))


@register("chart_bar_mean", _fold_sql(
    "SELECT coalesce(CAST(l_suppkey AS VARCHAR), '(empty)') AS label, avg(l_extendedprice) AS value "
    "FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1", 8, additive=False))
def chart_bar_mean(spark, sf_dir):
    return _bar_out(CH.category_bar(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", "mean"))


@register("chart_bar_natural", """
WITH g AS (SELECT strftime(o_orderdate, '%B') AS label, sum(o_totalprice) AS value FROM orders
           WHERE o_totalprice IS NOT NULL GROUP BY 1)
SELECT label, round(value, 2) AS value,
  CAST(coalesce(list_position(['January','February','March','April','May','June','July','August','September',
    'October','November','December'], label), 13) AS INTEGER) AS position
FROM g WHERE (SELECT count(*) FROM g) >= 2
""")
def chart_bar_natural(spark, sf_dir):
    o = FT.add_calendar(load(spark, sf_dir, "orders"), "o_orderdate")
    return _bar_out(CH.category_bar(o, "month_name", "o_totalprice", "sum"))


@register("chart_pie_count", _fold_sql(
    "SELECT coalesce(CAST(user_id AS VARCHAR), '(empty)') AS label, CAST(count(*) AS DOUBLE) AS value "
    "FROM events GROUP BY 1", 8))
def chart_pie_count(spark, sf_dir):
    return _bar_out(CH.custom_grouped(load(spark, sf_dir, "events"), "user_id", None, "count", 8))


@register("chart_custom_bar", _fold_sql(
    "SELECT coalesce(CAST(event_type AS VARCHAR), '(empty)') AS label, sum(value) AS value "
    "FROM events WHERE value IS NOT NULL GROUP BY 1", 20))
def chart_custom_bar(spark, sf_dir):
    return _bar_out(CH.custom_grouped(load(spark, sf_dir, "events"), "event_type", "value", "sum"))


DIST_STATS = """(SELECT count(*) AS n, count(DISTINCT o_totalprice) AS d, min(o_totalprice) AS lo, max(o_totalprice) AS hi,
  quantile_cont(o_totalprice, [0, 0.25, 0.5, 0.75, 1.0]) AS q FROM orders WHERE o_totalprice IS NOT NULL)"""


@register("chart_distribution_points", f"""
WITH s AS {DIST_STATS}
SELECT p.point, round(s.q[p.i], 2) AS value
FROM (VALUES (1, 'Lowest'), (2, '25% below'), (3, 'Middle'), (4, '25% above'), (5, 'Highest')) AS p(i, point)
CROSS JOIN s WHERE s.n >= 20 AND s.d >= 5
""")
def chart_distribution_points(spark, sf_dir):
    points, _ = CH.distribution(load(spark, sf_dir, "orders"), "o_totalprice")
    return points


@register("chart_distribution_bins", f"""
WITH s AS {DIST_STATS}
SELECT CAST(b AS INTEGER) AS bin, round(lo + b * (hi - lo) / 32, 4) AS bin_start, CAST(count(*) AS BIGINT) AS rows
FROM (SELECT CASE WHEN (hi - lo) / 32 = 0 THEN 0 ELSE least(floor((o_totalprice - lo) / ((hi - lo) / 32)), 31) END AS b, lo, hi
      FROM orders, s WHERE o_totalprice IS NOT NULL AND n >= 20 AND d >= 5)
GROUP BY b, lo, hi
""")
def chart_distribution_bins(spark, sf_dir):
    _, hist = CH.distribution(load(spark, sf_dir, "orders"), "o_totalprice")
    return hist.select("bin", F.round("bin_start", 4).alias("bin_start"), "rows")


@register("chart_box", """
WITH g AS (SELECT CAST(l_suppkey AS VARCHAR) AS l_suppkey, count(*) AS rows, quantile_cont(l_extendedprice, 0.5) AS median,
                  avg(l_extendedprice) AS mean, min(l_extendedprice) AS mn, max(l_extendedprice) AS mx
           FROM lineitem WHERE l_suppkey IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1),
h AS (SELECT * FROM g ORDER BY median DESC, l_suppkey LIMIT 8)
SELECT l_suppkey, CAST(rows AS BIGINT) AS rows, round(median, 2) AS median, round(mean, 2) AS mean,
       round(mn, 2) AS min, round(mx, 2) AS max FROM h WHERE (SELECT count(*) FROM h) >= 2
""")
def chart_box(spark, sf_dir):
    return CH.box_summary(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice")


@register("chart_box_overall", """
SELECT CAST(count(value) AS BIGINT) AS rows, round(quantile_cont(value, 0.5), 3) AS median, round(avg(value), 3) AS mean,
       round(min(value), 3) AS min, round(max(value), 3) AS max FROM events
""")
def chart_box_overall(spark, sf_dir):
    return CH.overall_box(load(spark, sf_dir, "events"), "value")


PIVOT_CELLS = """(SELECT o_orderpriority AS r, o_orderstatus AS c, sum(o_totalprice) AS value FROM orders
  WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1, 2)"""


@register("chart_pivot", f"""
WITH cells AS {PIVOT_CELLS},
rr AS (SELECT r FROM cells GROUP BY r ORDER BY sum(value) DESC, r LIMIT 12),
cc AS (SELECT c FROM cells GROUP BY c ORDER BY sum(value) DESC, c LIMIT 12)
SELECT r AS o_orderpriority, c AS o_orderstatus, round(value, 2) AS value FROM cells
WHERE r IN (SELECT r FROM rr) AND c IN (SELECT c FROM cc)
  AND (SELECT count(DISTINCT r) FROM cells) >= 2 AND (SELECT count(DISTINCT c) FROM cells) >= 2
""")
def chart_pivot(spark, sf_dir):
    p = CH.pivot_sum(load(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    return p.select("o_orderpriority", "o_orderstatus", rnd("value", 2).alias("value"))


@register("chart_pivot_strongest", f"""
SELECT r AS o_orderpriority, c AS o_orderstatus, round(value, 2) AS value FROM {PIVOT_CELLS}
ORDER BY value DESC, r, c LIMIT 1
""")
def chart_pivot_strongest(spark, sf_dir):
    p = CH.pivot_sum(load(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    s = CH.strongest_cell(p, "o_orderpriority", "o_orderstatus")
    return s.select("o_orderpriority", "o_orderstatus", rnd("value", 2).alias("value"))


@register("chart_crosstab", """
WITH b AS (SELECT CAST(l_suppkey AS VARCHAR) AS x, CAST(l_linenumber AS VARCHAR) AS y FROM lineitem),
tx AS (SELECT x FROM b GROUP BY x ORDER BY count(*) DESC, x LIMIT 15),
ty AS (SELECT y FROM b GROUP BY y ORDER BY count(*) DESC, y LIMIT 15),
cells AS (SELECT x, y, count(*) AS rows FROM b WHERE x IN (SELECT x FROM tx) AND y IN (SELECT y FROM ty) GROUP BY 1, 2)
SELECT x AS l_suppkey, y AS l_linenumber, CAST(rows AS BIGINT) AS rows FROM cells
WHERE (SELECT count(DISTINCT x) FROM cells) >= 2 AND (SELECT count(DISTINCT y) FROM cells) >= 2
""")
def chart_crosstab(spark, sf_dir):
    return CH.crosstab(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber")


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[i + 1:]:
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 2) + 0.0 AS r FROM lineitem")
    return "\nUNION ALL\n".join(parts)


@register("chart_correlation", _corr_sql())
def chart_correlation(spark, sf_dir):
    return CH.correlation_matrix(load(spark, sf_dir, "lineitem"), CORR_COLS)


WIDE = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax",
        "net": "l_extendedprice * (1 - l_discount)", "taxed": "l_extendedprice * (1 + l_tax)", "unit_price": "l_extendedprice / l_quantity",
        "saving": "l_extendedprice * l_discount", "line": "CAST(l_linenumber AS DOUBLE)", "key_digit": "CAST(l_orderkey % 10 AS DOUBLE)"}


def _wide_corr_sql() -> str:
    names = list(WIDE)
    parts = [f"SELECT '{a}' AS a, '{b}' AS b, round(corr({WIDE[a]}, {WIDE[b]}), 2) + 0.0 AS r FROM lineitem"
             for i, a in enumerate(names) for b in names[i + 1:]]
    return "\nUNION ALL\n".join(parts)


@register("chart_correlation_wide", _wide_corr_sql())
def chart_correlation_wide(spark, sf_dir):
    """Ten measures, all 45 pairs; the constant and the calendar number are no measures."""
    wide = load(spark, sf_dir, "lineitem").select(*[F.expr(x).alias(n) for n, x in WIDE.items()], F.lit(1.0).alias("one"),
                                                  F.year("l_shipdate").alias("year"))
    return CH.correlation_matrix(wide, [*WIDE, "one", "year"])


@register("chart_scatter", """
SELECT CAST(count(*) AS BIGINT) AS n, round(corr(l_quantity, l_extendedprice), 4) AS r,
  CASE WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.7 THEN 'strong'
       WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.35 THEN 'moderate' ELSE 'weak' END AS strength
FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL HAVING count(*) >= 20
""")
def chart_scatter(spark, sf_dir):
    return CH.scatter_relationship(load(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


@register("chart_scatter_sample", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL
ORDER BY md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), '42')), l_orderkey, l_linenumber
LIMIT 600
""")
def chart_scatter_sample(spark, sf_dir):
    return CH.scatter_sample(load(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice",
                             ["l_orderkey", "l_linenumber"])


@register("chart_line_events", """
WITH b AS (SELECT date_trunc('day', ts) AS x, value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
g AS (SELECT x, sum(value) AS y FROM b GROUP BY x)
SELECT strftime(x, '%Y-%m-%d %H:%M:%S') AS ts, round(y, 4) AS value FROM g WHERE (SELECT count(*) FROM g) >= 2
""")
def chart_line_events(spark, sf_dir):
    t = CH.line_table(load(spark, sf_dir, "events"), "ts", "value", "sum")
    return t.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.round("value", 4).alias("value"))


@register("chart_line_orders", """
WITH b AS (SELECT date_trunc('month', o_orderdate) AS x, o_totalprice AS v FROM orders
           WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL),
g AS (SELECT x, avg(v) AS y FROM b GROUP BY x)
SELECT strftime(x, '%Y-%m-%d %H:%M:%S') AS o_orderdate, round(y, 4) AS o_totalprice FROM g
WHERE (SELECT count(*) FROM g) >= 2
""")
def chart_line_orders(spark, sf_dir):
    t = CH.line_table(load(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "mean")
    return t.select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
                    F.round("o_totalprice", 4).alias("o_totalprice"))


@register("chart_line_thinned", """
WITH g AS (SELECT l_extendedprice AS x, sum(l_quantity) AS y FROM lineitem
           WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL GROUP BY 1),
r AS (SELECT x, y, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM g)
SELECT x AS l_extendedprice, round(y, 4) AS l_quantity FROM r
WHERE n >= 2 AND (n <= 600 OR floor(ceil(i * 599 / (n - 1)) * (n - 1) / 599) = i)
""")
def chart_line_thinned(spark, sf_dir):
    t = CH.line_table(load(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", "sum")
    return t.select("l_extendedprice", F.round("l_quantity", 4).alias("l_quantity"))


@register("chart_histogram_summary", """
SELECT * FROM (
  SELECT 'Rows' AS statistic, CAST(count(value) AS DOUBLE) AS value FROM events
  UNION ALL SELECT 'Average', round(avg(value), 3) FROM events
  UNION ALL SELECT 'Median', round(quantile_cont(value, 0.5), 3) FROM events
  UNION ALL SELECT 'Minimum', round(min(value), 3) FROM events
  UNION ALL SELECT 'Maximum', round(max(value), 3) FROM events)
""")
def chart_histogram_summary(spark, sf_dir):
    summary, _ = CH.custom_histogram(load(spark, sf_dir, "events"), "value")
    return summary


@register("chart_histogram_bins", """
WITH s AS (SELECT count(*) AS n, min(value) AS lo, max(value) AS hi,
                  CAST(least(40, greatest(10, floor(sqrt(count(*))))) AS INTEGER) AS k FROM events WHERE value IS NOT NULL)
SELECT CAST(b AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS rows
FROM (SELECT CASE WHEN (hi - lo) / k = 0 THEN 0 ELSE least(floor((value - lo) / ((hi - lo) / k)), k - 1) END AS b
      FROM events, s WHERE value IS NOT NULL)
GROUP BY b
""")
def chart_histogram_bins(spark, sf_dir):
    _, hist = CH.custom_histogram(load(spark, sf_dir, "events"), "value")
    return hist


@register("chart_evidence", """
SELECT CAST(o_orderpriority AS VARCHAR) AS o_orderpriority, CAST(count(*) AS BIGINT) AS records FROM orders
WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY records DESC, o_orderpriority LIMIT 8
""")
def chart_evidence(spark, sf_dir):
    return CH.evidence_counts(load(spark, sf_dir, "orders"), "o_orderpriority")


@register("chart_colour_groups", """
WITH t AS (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, CAST(event_type AS VARCHAR) LIMIT 3)
SELECT coalesce(t.event_type, 'Other') AS colour_group, CAST(count(*) AS BIGINT) AS points,
       round(corr(e.value, CAST(e.user_id AS DOUBLE)), 4) + 0.0 AS r
FROM events e LEFT JOIN t ON CAST(e.event_type AS VARCHAR) = t.event_type
GROUP BY 1
""")
def chart_colour_groups(spark, sf_dir):
    # A12 colouring: the three most frequent groups keep their name, the rest
    # are Other; points and correlation per colour group.
    e = CH.colour_groups(load(spark, sf_dir, "events"), "event_type")
    return e.groupBy("colour_group").agg(F.count(F.lit(1)).cast("bigint").alias("points"),
                                         rnd(F.corr("value", F.col("user_id").cast("double")), 4).alias("r"))
