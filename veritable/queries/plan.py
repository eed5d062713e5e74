"""Question plans (P1, P12, P13, A1-A7) on orders, lineitem and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritable.plans.query import ask
from veritable.queries.registry import register
from veritable.sources.tables import load

ORDERS_ROLES = {"o_orderkey": "identifier", "o_custkey": "identifier", "o_orderdate": "datetime",
                "o_orderstatus": "category", "o_orderpriority": "category", "o_totalprice": "measure"}
LINEITEM_ROLES = {"l_orderkey": "identifier", "l_partkey": "identifier", "l_suppkey": "identifier",
                  "l_linenumber": "category", "l_shipdate": "datetime"}
EVENTS_ROLES = {"event_id": "identifier", "user_id": "identifier", "ts": "datetime",
                "event_type": "category", "props": "text", "value": "measure"}


def _orders(spark, sf_dir):
    return load(spark, sf_dir, "orders")


@register("plan_sum_month_status", """
SELECT period, o_orderstatus, round(v, 2) AS total_o_totalprice FROM (
  SELECT strftime(o_orderdate, '%Y-%m') AS period, o_orderstatus, coalesce(sum(o_totalprice), 0.0) AS v
  FROM orders WHERE o_orderdate IS NOT NULL AND o_orderstatus IS NOT NULL
  GROUP BY 1, 2 ORDER BY period DESC, o_orderstatus DESC LIMIT 200)
""")
def plan_sum_month_status(spark, sf_dir):
    plan = {"measure": "o_totalprice", "aggregation": "sum", "group_by": ["o_orderstatus"],
            "time_grain": "month", "limit": 200}
    return ask(plan, _orders(spark, sf_dir), ORDERS_ROLES).table


@register("plan_headline_month", """
WITH g AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS period, coalesce(sum(o_totalprice), 0.0) AS v
  FROM orders WHERE lower(trim(o_orderstatus)) <> 'p' OR o_orderstatus IS NULL GROUP BY 1),
e AS (SELECT arg_min(period, period) AS fl, arg_min(v, period) AS fv,
             arg_max(period, period) AS ll, arg_max(v, period) AS lv, count(*) AS n FROM g)
SELECT 'series' AS kind, fl AS first_label, round(fv, 2) AS first_value, ll AS last_label,
       round(lv, 2) AS last_value,
       round(CASE WHEN coalesce(fv, 0) <> 0 THEN (lv - fv) / fv * 100 ELSE 0.0 END, 2) AS change_pct,
       CASE WHEN (CASE WHEN coalesce(fv, 0) <> 0 THEN (lv - fv) / fv * 100 ELSE 0.0 END) > 2 THEN 'up'
            WHEN (CASE WHEN coalesce(fv, 0) <> 0 THEN (lv - fv) / fv * 100 ELSE 0.0 END) < -2 THEN 'down'
            ELSE 'flat' END AS direction,
       CAST(n AS BIGINT) AS total_rows
FROM e
""")
def plan_headline_month(spark, sf_dir):
    plan = {"measure": "o_totalprice", "aggregation": "sum", "time_grain": "month",
            "filters": [{"column": "o_orderstatus", "operator": "!=", "value": "p"}], "limit": 12}
    return ask(plan, _orders(spark, sf_dir), ORDERS_ROLES).headline


@register("plan_mean_priority", """
SELECT o_orderpriority, round(avg(o_totalprice), 2) AS average_o_totalprice
FROM orders
WHERE (lower(trim(o_orderstatus)) NOT IN ('p') OR o_orderstatus IS NULL) AND o_orderpriority IS NOT NULL
GROUP BY 1 ORDER BY avg(o_totalprice) DESC NULLS LAST, o_orderpriority LIMIT 20
""")
def plan_mean_priority(spark, sf_dir):
    plan = {"measure": "O Totalprice", "aggregation": "mean", "group_by": ["o_orderpriority"],
            "filters": [{"column": "o_orderstatus", "operator": "not in", "value": ["P"]}]}
    return ask(plan, _orders(spark, sf_dir), ORDERS_ROLES).table


@register("plan_median_flag_status", """
SELECT l_returnflag, l_linestatus, l_linenumber, round(quantile_cont(l_extendedprice, 0.5), 2) AS typical_l_extendedprice
FROM lineitem WHERE l_discount >= 0.05 AND l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL AND l_linenumber IS NOT NULL
GROUP BY 1, 2, 3
ORDER BY quantile_cont(l_extendedprice, 0.5) ASC NULLS LAST, l_returnflag, l_linestatus, l_linenumber LIMIT 20
""")
def plan_median_flag_status(spark, sf_dir):
    plan = {"measure": "l_extendedprice", "aggregation": "median",
            "group_by": ["l_returnflag", "l_linestatus", "L LineNumber"],
            "filters": [{"column": "l_discount", "operator": ">=", "value": "0.05"},
                        {"column": "l_tax", "operator": ">", "value": "not a number"}],
            "sort_descending": False}
    return ask(plan, load(spark, sf_dir, "lineitem"), LINEITEM_ROLES).table


@register("plan_count_week", """
SELECT period, round(v, 2) AS number_of_records FROM (
  SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' ||
         strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d') AS period,
         CAST(count(*) AS DOUBLE) AS v
  FROM events WHERE lower(trim(event_type)) IN ('click', 'view') AND ts IS NOT NULL
  GROUP BY 1 ORDER BY period DESC LIMIT 500)
""")
def plan_count_week(spark, sf_dir):
    plan = {"aggregation": "count", "time_grain": "week", "limit": 500,
            "filters": [{"column": "event_type", "operator": "in", "value": ["Click", "VIEW"]}]}
    return ask(plan, load(spark, sf_dir, "events"), EVENTS_ROLES).table


@register("plan_min_day_type", """
SELECT period, event_type, round(v, 2) AS lowest_value FROM (
  SELECT strftime(ts, '%Y-%m-%d') AS period, event_type, min(value) AS v
  FROM events WHERE contains(lower(CAST(event_type AS VARCHAR)), 'i') AND ts IS NOT NULL AND event_type IS NOT NULL
  GROUP BY 1, 2 ORDER BY period DESC, event_type DESC LIMIT 50)
""")
def plan_min_day_type(spark, sf_dir):
    plan = {"measure": "value", "aggregation": "min", "time_grain": "day", "group_by": ["event_type"],
            "filters": [{"column": "event_type", "operator": "contains", "value": "I"}], "limit": 50}
    return ask(plan, load(spark, sf_dir, "events"), EVENTS_ROLES).table


@register("plan_max_quarter", """
SELECT period, round(v, 2) AS highest_l_quantity FROM (
  SELECT CAST(year(l_shipdate) AS VARCHAR) || 'Q' || CAST(quarter(l_shipdate) AS VARCHAR) AS period,
         max(l_quantity) AS v
  FROM lineitem WHERE lower(trim(l_linestatus)) = 'o' AND l_shipdate IS NOT NULL
  GROUP BY 1 ORDER BY period DESC LIMIT 20)
""")
def plan_max_quarter(spark, sf_dir):
    plan = {"measure": "l_quantity", "aggregation": "max", "time_grain": "quarter",
            "filters": [{"column": "l_linestatus", "operator": "=", "value": "o"}]}
    return ask(plan, load(spark, sf_dir, "lineitem"), LINEITEM_ROLES).table


@register("plan_nunique_year", """
SELECT period, round(v, 2) AS distinct_o_custkey FROM (
  SELECT CAST(year(o_orderdate) AS VARCHAR) AS period, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS v
  FROM orders WHERE o_totalprice < 300000 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
       AND o_orderdate IS NOT NULL
  GROUP BY 1 ORDER BY period DESC LIMIT 20)
""")
def plan_nunique_year(spark, sf_dir):
    plan = {"measure": "o_custkey", "aggregation": "nunique", "time_grain": "year",
            "filters": [{"column": "o_totalprice", "operator": "<", "value": 300000},
                        {"column": "o_orderpriority", "operator": "not in", "value": ["1-urgent", "2-high"]}]}
    return ask(plan, _orders(spark, sf_dir), ORDERS_ROLES).table


@register("plan_top_customers", """
SELECT o_custkey, round(v, 2) AS total_o_totalprice FROM (
  SELECT o_custkey, coalesce(sum(o_totalprice), 0.0) AS v FROM orders
  WHERE o_custkey IS NOT NULL GROUP BY 1 ORDER BY v DESC NULLS LAST, o_custkey LIMIT 10)
""")
def plan_top_customers(spark, sf_dir):
    plan = {"measure": "o_totalprice", "aggregation": "sum", "group_by": ["o_custkey"], "limit": 10}
    return ask(plan, _orders(spark, sf_dir), ORDERS_ROLES).table


@register("plan_top_headline", """
WITH g AS (SELECT o_custkey, coalesce(sum(o_totalprice), 0.0) AS v FROM orders
           WHERE o_custkey IS NOT NULL GROUP BY 1),
t AS (SELECT o_custkey, v FROM g ORDER BY v DESC, o_custkey LIMIT 1)
SELECT 'descending' AS kind, CAST(t.o_custkey AS VARCHAR) AS first_label, round(t.v, 2) AS first_value,
       CAST(NULL AS VARCHAR) AS last_label, CAST(NULL AS DOUBLE) AS last_value,
       round(t.v / (SELECT sum(v) FROM g) * 100, 2) AS change_pct, CAST(NULL AS VARCHAR) AS direction,
       (SELECT CAST(count(*) AS BIGINT) FROM g) AS total_rows
FROM t
""")
def plan_top_headline(spark, sf_dir):
    plan = {"measure": "o_totalprice", "aggregation": "sum", "group_by": ["o_custkey"], "limit": 10}
    return ask(plan, _orders(spark, sf_dir), ORDERS_ROLES).headline


@register("plan_global_sum", """
SELECT round(coalesce(sum(l_extendedprice), 0.0), 2) AS total_l_extendedprice
FROM lineitem WHERE l_quantity <= 10 AND (lower(trim(l_returnflag)) <> 'r' OR l_returnflag IS NULL)
""")
def plan_global_sum(spark, sf_dir):
    plan = {"measure": "l_extendedprice", "aggregation": "sum",
            "filters": [{"column": "l_quantity", "operator": "<=", "value": 10},
                        {"column": "l_returnflag", "operator": "!=", "value": "R"}]}
    return ask(plan, load(spark, sf_dir, "lineitem"), LINEITEM_ROLES).table


@register("plan_large_id", """
SELECT l_orderkey + 9007199254740992 AS big_key, round(CAST(count(*) AS DOUBLE), 2) AS number_of_records
FROM lineitem WHERE l_orderkey + 9007199254740992 IN (9007199254740993, 9007199254740994, 9007199254740995)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20
""")
def plan_large_id(spark, sf_dir):
    """Keys moved beyond 2^53, where doubles no longer tell neighbours apart."""
    df = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + F.lit(2**53)).alias("big_key"))
    plan = {"aggregation": "count", "group_by": ["big_key"],
            "filters": [{"column": "big_key", "operator": "in", "value": [2**53 + 1, str(2**53 + 2), 2**53 + 3]}]}
    return ask(plan, df, {"big_key": "identifier"}).table
