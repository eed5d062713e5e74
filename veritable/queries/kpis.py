"""KPI queries (K1-K15) on orders, lineitem x part and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritable.operators import features as FT
from veritable.operators import kpis as K
from veritable.queries.features import _lineitem_with_unit_cost
from veritable.queries.registry import register
from veritable.sources.tables import load

ORDERS_KPI = K.KpiColumns(revenue="o_totalprice", entity="o_custkey", date="o_orderdate", money_scale=2)


def _out(df):
    return df.select("kpi_id", F.round("value", 4).alias("value"), "unit")


@register("kpi_scalar_orders", """
SELECT * FROM (VALUES ('record_count', 'count'), ('total_revenue', 'money'), ('average_order_value', 'money'),
                      ('active_customers', 'count')) AS u(kpi_id, unit)
JOIN (
  SELECT 'record_count' AS kpi_id, CAST(count(*) AS DOUBLE) AS value FROM orders
  UNION ALL SELECT 'total_revenue', CAST(sum(CAST(o_totalprice AS DECIMAL(38,2))) AS DOUBLE) FROM orders
  UNION ALL SELECT 'average_order_value', round(avg(o_totalprice), 4) FROM orders
  UNION ALL SELECT 'active_customers', CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM orders
) v USING (kpi_id)
""")
def kpi_scalar_orders(spark, sf_dir):
    return _out(K.scalar_kpis(load(spark, sf_dir, "orders"), ORDERS_KPI))


@register("kpi_entity_orders", """
WITH per AS (SELECT o_custkey, count(*) AS rows, sum(CAST(o_totalprice AS DECIMAL(38,2))) AS total
             FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1),
n AS (SELECT count(*) AS n, sum(total) AS grand FROM per),
top AS (SELECT sum(total) AS s FROM (SELECT total FROM per ORDER BY total DESC
        LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) FROM per)))
SELECT 'repeat_rate' AS kpi_id, round((SELECT count(*) FROM per WHERE rows > 1) * 100.0 / n, 4) AS value, '%' AS unit FROM n
UNION ALL
SELECT 'top_10pct_share', round(CAST(s AS DOUBLE) / CAST(grand AS DOUBLE) * 100, 4), '%' FROM top, n
""")
def kpi_entity_orders(spark, sf_dir):
    return _out(K.entity_kpis(load(spark, sf_dir, "orders"), ORDERS_KPI))


MONTHS_SQL = """(SELECT strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice) AS total FROM orders
  WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1)"""


@register("kpi_monthly_orders", f"""
WITH m AS {MONTHS_SQL},
r AS (SELECT period, total, row_number() OVER (ORDER BY period) AS i, count(*) OVER () AS n FROM m),
g AS (SELECT max(n) AS n, avg(CASE WHEN i <= floor(n / 2) THEN total END) AS earlier,
             avg(CASE WHEN i > floor(n / 2) THEN total END) AS later,
             arg_max(total, total) AS peak FROM r)
SELECT 'growth_rate' AS kpi_id, round((later - earlier) / earlier * 100, 4) AS value, '%' AS unit FROM g
WHERE n >= 4 AND earlier <> 0
UNION ALL SELECT 'strongest_month', round(peak, 4), 'money' FROM g WHERE n >= 3
""")
def kpi_monthly_orders(spark, sf_dir):
    return _out(K.monthly_kpis(load(spark, sf_dir, "orders"), ORDERS_KPI))


@register("kpi_strongest_month_label", f"""
WITH m AS {MONTHS_SQL}
SELECT period AS strongest_month FROM m ORDER BY total DESC, period LIMIT 1
""")
def kpi_strongest_month_label(spark, sf_dir):
    m = K.monthly_kpis(load(spark, sf_dir, "orders"), ORDERS_KPI)
    return m.filter(F.col("kpi_id") == "strongest_month").select(
        F.split(F.col("label"), " ")[0].alias("strongest_month"))


@register("kpi_monthly_totals", f"""
SELECT period, round(total, 2) AS total FROM {MONTHS_SQL}
""")
def kpi_monthly_totals(spark, sf_dir):
    m = K.monthly_totals(load(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")
    return m.select("period", F.round("total", 2).alias("total"))


@register("kpi_profit_units", """
WITH j AS (SELECT l.l_extendedprice AS revenue, l.l_extendedprice - p.p_retailprice * l.l_quantity AS profit,
                  l.l_quantity FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey)
SELECT 'record_count' AS kpi_id, CAST(count(*) AS DOUBLE) AS value, 'count' AS unit FROM j
UNION ALL SELECT 'total_revenue', round(sum(revenue), 4), 'money' FROM j
UNION ALL SELECT 'average_order_value', round(avg(revenue), 4), 'money' FROM j
UNION ALL SELECT 'total_profit', round(sum(profit), 4), 'money' FROM j
UNION ALL SELECT 'profit_margin', round(sum(profit) / sum(revenue) * 100, 4), '%' FROM j
UNION ALL SELECT 'units_sold', round(sum(l_quantity), 4), 'count' FROM j
""")
def kpi_profit_units(spark, sf_dir):
    df = FT.add_profit(_lineitem_with_unit_cost(spark, sf_dir), "l_extendedprice", "unit_cost", "l_quantity")
    cols = K.KpiColumns(revenue="l_extendedprice", profit="profit", quantity="l_quantity")
    out = K.scalar_kpis(df, cols)
    return out.select("kpi_id", F.round("value", 4).alias("value"), "unit")


@register("kpi_contextual_events", """
SELECT 'observations' AS kpi_id, CAST(count(value) AS DOUBLE) AS value, 'count' AS unit FROM events
UNION ALL SELECT 'average_value', round(avg(value), 4), 'value' FROM events
UNION ALL SELECT 'typical_value', round(quantile_cont(value, 0.5), 4), 'value' FROM events
UNION ALL SELECT 'largest_value', round(max(value), 4), 'value' FROM events
""")
def kpi_contextual_events(spark, sf_dir):
    return _out(K.contextual_kpis(load(spark, sf_dir, "events"), "value"))


@register("kpi_custom_ratio", """
SELECT 'tax_to_discount' AS kpi_id, round(sum(l_tax) / sum(l_discount) * 100, 4) AS value, '%' AS unit FROM lineitem
HAVING sum(l_discount) <> 0
UNION ALL
SELECT 'total_quantity', round(sum(l_quantity), 4), 'value' FROM lineitem
""")
def kpi_custom_ratio(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    a = K.custom_kpi(li, "tax_to_discount", "l_tax", "l_discount", percentage=True)
    b = K.custom_kpi(li, "total_quantity", "l_quantity")
    return _out(a.unionByName(b))


@register("kpi_all_orders", """
SELECT kpi_id FROM (VALUES ('record_count'), ('total_revenue'), ('average_order_value'), ('active_customers'),
  ('repeat_rate'), ('top_10pct_share'), ('growth_rate'), ('strongest_month')) AS t(kpi_id)
""")
def kpi_all_orders(spark, sf_dir):
    return K.all_kpis(load(spark, sf_dir, "orders"), ORDERS_KPI).select("kpi_id")
