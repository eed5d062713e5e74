"""Cleaning queries: duplicates (D1-D3), outliers (O1-O5), column ops."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritable.functions.dates import date_orders
from veritable.operators import cleaning as C
from veritable.operators import duplicates as D
from veritable.operators import outliers as O
from veritable.operators import profile as P
from veritable.queries.profile import EVENTS_BLANKS_SQL, EVENTS_KINDS, events_with_blanks, role_sql
from veritable.queries.registry import register
from veritable.sources.tables import load

LI_KEY = ["l_orderkey", "l_linenumber"]
LI_REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
           "l_returnflag", "l_linestatus", "l_shipdate"]


@register("dup_find", """
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS extra_copies, CAST(count(*) AS BIGINT) AS repeated_groups,
       CAST(coalesce(sum(c), 0) AS BIGINT) AS rows_involved
FROM (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
""")
def dup_find(spark, sf_dir):
    return D.find_duplicates(load(spark, sf_dir, "lineitem"), LI_KEY)


@register("dup_find_full_row", """
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS extra_copies, CAST(count(*) AS BIGINT) AS repeated_groups,
       CAST(coalesce(sum(c), 0) AS BIGINT) AS rows_involved
FROM (SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS c FROM orders GROUP BY ALL HAVING count(*) > 1)
""")
def dup_find_full_row(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    return D.find_duplicates(o)


def _li_out(df):
    return df.select(*LI_KEY, *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c == "l_shipdate" else F.col(c)
                                for c in LI_REST])


@register("dup_drop_subset", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(c + " ASC NULLS FIRST" for c in LI_REST)}) = 1
""")
def dup_drop_subset(spark, sf_dir):
    return _li_out(D.drop_duplicates(load(spark, sf_dir, "lineitem"), LI_KEY))


@register("dup_drop_full_row", """
SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders
""")
def dup_drop_full_row(spark, sf_dir):
    return D.drop_duplicates(load(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


@register("dup_merge", f"""
SELECT l_orderkey, l_linenumber,
       arg_min(l_partkey, row({", ".join(LI_REST)})) AS l_partkey,
       arg_min(l_suppkey, row({", ".join(LI_REST)})) AS l_suppkey,
       round(coalesce(sum(l_quantity), 0), 2) AS l_quantity,
       round(coalesce(sum(l_extendedprice), 0), 2) AS l_extendedprice,
       arg_min(l_discount, row({", ".join(LI_REST)})) AS l_discount,
       arg_min(l_tax, row({", ".join(LI_REST)})) AS l_tax,
       arg_min(l_returnflag, row({", ".join(LI_REST)})) AS l_returnflag,
       arg_min(l_linestatus, row({", ".join(LI_REST)})) AS l_linestatus,
       strftime(arg_min(l_shipdate, row({", ".join(LI_REST)})), '%Y-%m-%d %H:%M:%S') AS l_shipdate
FROM lineitem GROUP BY l_orderkey, l_linenumber
""")
def dup_merge(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    merged = D.merge_duplicates(li, ["l_quantity", "l_extendedprice"], LI_KEY, order_by=LI_REST)
    merged = merged.withColumn("l_quantity", F.round("l_quantity", 2)).withColumn(
        "l_extendedprice", F.round("l_extendedprice", 2))
    return _li_out(merged)


# --- outliers ---------------------------------------------------------------

OUT_COLS = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def _bounds_sql(table: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        parts.append(f"""SELECT '{c}' AS column_name, count({c}) AS n, count(DISTINCT {c}) AS dc,
  quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table}""")
    q = " UNION ALL ".join(parts)
    counts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count_if({c} < b.lower) AS lo_c, count_if({c} > b.upper) AS hi_c "
        f"FROM {table}, (SELECT * FROM bq WHERE column_name = '{c}') b" for c in columns
    )
    return f"""
WITH q AS ({q}),
bq AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q),
cnt AS ({counts})
SELECT bq.column_name, CAST(n AS BIGINT) AS n, dc >= 5 AS enough_distinct,
       round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr, round(lower, 6) AS lower, round(upper, 6) AS upper,
       CAST(lo_c AS BIGINT) AS low_count, CAST(hi_c AS BIGINT) AS high_count, CAST(lo_c + hi_c AS BIGINT) AS count,
       round(CAST(lo_c + hi_c AS DOUBLE) / n, 6) AS share,
       (n >= 30 AND dc >= 5 AND iqr > 0 AND lo_c + hi_c > 0) AS eligible
FROM bq JOIN cnt USING (column_name)
"""


def _round_bounds(b):
    return b.select("column_name", "n", "enough_distinct", *[F.round(c, 6).alias(c) for c in ("q1", "q3", "iqr", "lower", "upper")],
                    "low_count", "high_count", "count", F.round("share", 6).alias("share"), "eligible")


@register("outlier_bounds", _bounds_sql("lineitem", OUT_COLS))
def outlier_bounds(spark, sf_dir):
    return _round_bounds(O.outlier_bounds(load(spark, sf_dir, "lineitem"), OUT_COLS))


@register("outlier_candidates", f"""
SELECT column_name, share FROM ({_bounds_sql("lineitem", OUT_COLS)}) WHERE eligible AND share <= 0.15
""")
def outlier_candidates(spark, sf_dir):
    b = O.outlier_bounds(load(spark, sf_dir, "lineitem"), OUT_COLS)
    return O.outlier_candidates(b).select("column_name", F.round("share", 6).alias("share"))


@register("outlier_remove", """
WITH b AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, b
WHERE NOT coalesce(l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1), false)
""")
def outlier_remove(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    b = O.outlier_bounds(li, ["l_extendedprice"])
    return O.remove_outliers(li, b, "l_extendedprice").select("l_orderkey", "l_linenumber", "l_extendedprice")


@register("outlier_cap", """
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
c AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b)
SELECT event_id, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value
FROM events, c
""")
def outlier_cap(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    b = O.outlier_bounds(e, ["value"])
    return O.cap_outliers(e, b, "value").select("event_id", F.round("value", 6).alias("value"))


@register("outlier_flag", """
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), false) AS value_is_unusual
FROM events, b
""")
def outlier_flag(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    b = O.outlier_bounds(e, ["value"])
    return O.flag_outliers(e, b, "value").select("event_id", "value_is_unusual")


@register("outlier_examples", """
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
c AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b)
SELECT * FROM (SELECT 'low' AS side, value FROM events, c WHERE value < lo ORDER BY value LIMIT 10)
UNION ALL
SELECT * FROM (SELECT 'high' AS side, value FROM events, c WHERE value > hi ORDER BY value DESC LIMIT 10)
""")
def outlier_examples(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return O.outlier_examples(e, O.outlier_bounds(e, ["value"]), "value")


# --- column operations on events with blanks ---------------------------------

@register("fill_median", f"""
WITH b AS {EVENTS_BLANKS_SQL}
SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM b)), 6) AS value FROM b
""")
def fill_median(spark, sf_dir):
    df = C.fill_missing(events_with_blanks(spark, sf_dir), "value", "median")
    return df.select("event_id", F.round("value", 6).alias("value"))


@register("fill_mean", f"""
WITH b AS {EVENTS_BLANKS_SQL}
SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM b)), 6) AS value FROM b
""")
def fill_mean(spark, sf_dir):
    df = C.fill_missing(events_with_blanks(spark, sf_dir), "value", "mean")
    return df.select("event_id", F.round("value", 6).alias("value"))


@register("fill_mode", f"""
WITH b AS {EVENTS_BLANKS_SQL},
m AS (SELECT event_type AS v FROM b WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)
SELECT event_id, coalesce(event_type, (SELECT v FROM m)) AS event_type FROM b
""")
def fill_mode(spark, sf_dir):
    return C.fill_missing(events_with_blanks(spark, sf_dir), "event_type", "mode").select("event_id", "event_type")


@register("fill_zero_label", f"""
WITH b AS {EVENTS_BLANKS_SQL}
SELECT event_id, coalesce(CAST(user_id AS DOUBLE), 0.0) AS user_id, coalesce(props, 'Unknown') AS props FROM b
""")
def fill_zero_label(spark, sf_dir):
    df = C.fill_missing(events_with_blanks(spark, sf_dir), "user_id", "zero")
    df = C.fill_missing(df, "props", "")
    return df.select("event_id", "user_id", "props")


@register("convert_number", """
SELECT event_id, try_cast(regexp_replace(CAST(props AS VARCHAR), '[^0-9.\\-eE]', '', 'g') AS DOUBLE) AS props
FROM events
""")
def convert_number(spark, sf_dir):
    return C.convert_column(load(spark, sf_dir, "events"), "props", "number").select("event_id", "props")


@register("convert_report", f"""
WITH b AS {EVENTS_BLANKS_SQL}
SELECT 'props' AS column_name, 'number' AS target, CAST(count_if(props IS NULL) AS BIGINT) AS blanks_before,
  CAST(count_if(try_cast(regexp_replace(props, '[^0-9.\\-eE]', '', 'g') AS DOUBLE) IS NULL) AS BIGINT) AS blanks_after,
  CAST(greatest(count_if(try_cast(regexp_replace(props, '[^0-9.\\-eE]', '', 'g') AS DOUBLE) IS NULL) - count_if(props IS NULL), 0) AS BIGINT) AS unreadable
FROM b
""")
def convert_report(spark, sf_dir):
    return C.convert_report(events_with_blanks(spark, sf_dir), "props", "number")


@register("convert_date_text", """
SELECT event_id, strftime(CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ts_text
FROM events
""")
def convert_date_text(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"))
    back = C.convert_column(e, "ts_text", "date")
    return back.select("event_id", F.date_format("ts_text", "yyyy-MM-dd HH:mm:ss").alias("ts_text"))


@register("filter_rows", f"""
WITH b AS {EVENTS_BLANKS_SQL}
SELECT event_id, event_type FROM b WHERE NOT coalesce(lower(trim(event_type)) IN ('click', 'view'), false)
""")
def filter_rows(spark, sf_dir):
    return C.filter_rows(events_with_blanks(spark, sf_dir), "event_type", ["Click", "VIEW"]).select("event_id", "event_type")


@register("drop_missing", f"""
WITH b AS {EVENTS_BLANKS_SQL}
SELECT event_id, value FROM b WHERE value IS NOT NULL
""")
def drop_missing(spark, sf_dir):
    return C.drop_missing_rows(events_with_blanks(spark, sf_dir), "value").select("event_id", "value")


@register("suggest_actions", f"""
WITH p AS ({role_sql("events", EVENTS_KINDS, EVENTS_BLANKS_SQL)}),
n AS (SELECT count(*) AS n_rows FROM events)
SELECT column_name, role,
  CASE WHEN role = 'constant' THEN 'drop'
       WHEN CAST(missing_count AS DOUBLE) / n_rows >= 0.6 THEN 'drop'
       WHEN role = 'measure' AND missing_count > 0 THEN 'fill'
       WHEN role = 'category' AND missing_count > 0 THEN 'fill'
       WHEN role = 'text' AND unique_count > n_rows * 0.8 THEN 'drop'
       ELSE 'keep' END AS action,
  CASE WHEN NOT (role = 'constant' OR CAST(missing_count AS DOUBLE) / n_rows >= 0.6)
            AND role IN ('measure', 'category') AND missing_count > 0
       THEN CASE WHEN role = 'measure' THEN 'median' ELSE 'Unknown' END END AS strategy
FROM p, n
""")
def suggest_actions(spark, sf_dir):
    prof = P.profile_dataset(events_with_blanks(spark, sf_dir))
    return C.suggest_actions(prof)


@register("excludable_status", """
SELECT CAST(NULL AS VARCHAR) AS column_name, CAST(NULL AS VARCHAR) AS value WHERE false
""")
def excludable_status(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    # only status-like names can qualify, so only they are profiled
    names = [c for c in e.columns if any(w in c.casefold() for w in C.STATUS_NAME_WORDS)]
    sub = e.select(*names)
    prof = P.profile_dataset(sub)
    tops = P.category_stats(P.histogram(sub), names)
    return C.excludable_values(prof, tops)


@register("numeric_columns", f"""
WITH b AS {EVENTS_BLANKS_SQL}
SELECT column_name, CAST(parsed AS BIGINT) AS parsed,
       parsed >= least(n, greatest(3, ceil(n * 0.7))) AS is_numeric
FROM (
  SELECT 'event_id' AS column_name, count(try_cast(CAST(event_id AS VARCHAR) AS DOUBLE)) AS parsed, count(*) AS n FROM b
  UNION ALL SELECT 'ts', count(try_cast(CAST(ts AS VARCHAR) AS DOUBLE)), count(*) FROM b
  UNION ALL SELECT 'user_id', count(try_cast(CAST(user_id AS VARCHAR) AS DOUBLE)), count(*) FROM b
  UNION ALL SELECT 'event_type', count(try_cast(event_type AS DOUBLE)), count(*) FROM b
  UNION ALL SELECT 'value', count(try_cast(CAST(value AS VARCHAR) AS DOUBLE)), count(*) FROM b
  UNION ALL SELECT 'props', count(try_cast(props AS DOUBLE)), count(*) FROM b)
""")
def numeric_columns(spark, sf_dir):
    return C.numeric_columns(events_with_blanks(spark, sf_dir))


def _order_dates(spark, sf_dir):
    """Order dates as text in two orders: 03/04/2024 alone does not say which."""
    o = load(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day_month"),
                    F.date_format("o_orderdate", "M/d/yyyy").alias("month_day"),
                    F.date_format(F.trunc("o_orderdate", "month"), "d/M/yyyy").alias("firsts"))


@register("convert_date_order", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day_month, strftime(o_orderdate, '%Y-%m-%d') AS month_day FROM orders
""")
def convert_date_order(spark, sf_dir):
    d = _order_dates(spark, sf_dir)
    out = C.convert_column(C.convert_column(d, "day_month", "date"), "month_day", "date")
    return out.select("o_orderkey", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("day_month", "month_day")])


@register("date_order_votes", """
WITH d AS (SELECT extract(day FROM o_orderdate) AS day FROM orders),
v AS (SELECT count(*) FILTER (WHERE day > 12)::BIGINT AS n FROM d)
SELECT 'day_month' AS column_name, n AS against_month_first, 0::BIGINT AS against_day_first, n > 0 AS day_first FROM v
UNION ALL SELECT 'month_day', 0, n, false FROM v
UNION ALL SELECT 'firsts', 0, 0, false FROM v
""")
def date_order_votes(spark, sf_dir):
    return date_orders(_order_dates(spark, sf_dir), ["day_month", "month_day", "firsts"])
