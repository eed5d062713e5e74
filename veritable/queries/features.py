"""Feature queries (F1-F10) on orders, lineitem x part and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritable.operators import features as FT
from veritable.operators import joining as J
from veritable.queries.registry import register
from veritable.sources.tables import load


@register("feature_calendar", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter,
       CAST(month(o_orderdate) AS INTEGER) AS month, strftime(o_orderdate, '%B') AS month_name,
       strftime(o_orderdate, '%A') AS day_of_week, coalesce(isodow(o_orderdate) IN (5, 6), false) AS is_weekend
FROM orders
""")
def feature_calendar(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return FT.add_calendar(o, "o_orderdate").drop("o_orderdate")


@register("feature_size_band", """
WITH q AS (SELECT quantile_cont(o_totalprice, [0, 0.25, 0.5, 0.75, 1.0]) AS e FROM orders)
SELECT o_orderkey,
  CASE WHEN NOT coalesce(e[1] < e[2] AND e[2] < e[3] AND e[3] < e[4] AND e[4] < e[5], false) THEN 'Unclassified'
       WHEN o_totalprice IS NULL THEN NULL
       WHEN o_totalprice <= e[2] THEN 'Small' WHEN o_totalprice <= e[3] THEN 'Medium'
       WHEN o_totalprice <= e[4] THEN 'Large' WHEN o_totalprice <= e[5] THEN 'Very large' END AS revenue_tier
FROM orders, q
""")
def feature_size_band(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return FT.add_size_band(o, "o_totalprice").select("o_orderkey", "revenue_tier")


@register("feature_size_band_flat", """
SELECT event_id, 'Unclassified' AS revenue_tier FROM events
""")
def feature_size_band_flat(spark, sf_dir):
    # A measure whose quartile cut points coincide (a constant derived from the
    # event id) classifies nothing.
    e = load(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 0).alias("flat"))
    return FT.add_size_band(e, "flat").select("event_id", "revenue_tier")


@register("feature_entity_value", """
SELECT o.o_orderkey, p.t AS customer_total_value, p.n AS customer_order_count, p.a AS customer_average_order
FROM orders o LEFT JOIN (
  SELECT o_custkey, round(sum(o_totalprice), 2) AS t, count(o_totalprice) AS n, round(avg(o_totalprice), 2) AS a
  FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1) p ON o.o_custkey = p.o_custkey
""")
def feature_entity_value(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    out = FT.add_entity_value(o, "o_custkey", "o_totalprice")
    return out.select("o_orderkey", "customer_total_value", "customer_order_count", "customer_average_order")


def _lineitem_with_unit_cost(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    part = load(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("unit_cost"))
    return J.apply_join(li, part, "l_partkey", "p_partkey")


@register("feature_profit", """
SELECT l.l_orderkey, l.l_linenumber,
       round(l.l_extendedprice - p.p_retailprice * l.l_quantity, 4) AS profit,
       CASE WHEN l.l_extendedprice > 0 THEN
         round((l.l_extendedprice - p.p_retailprice * l.l_quantity) / l.l_extendedprice * 100, 2) + 0.0 END AS profit_margin_pct
FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
""")
def feature_profit(spark, sf_dir):
    df = FT.add_profit(_lineitem_with_unit_cost(spark, sf_dir), "l_extendedprice", "unit_cost", "l_quantity")
    return df.select("l_orderkey", "l_linenumber", F.round("profit", 4).alias("profit"), "profit_margin_pct")


@register("feature_net_revenue", """
WITH m AS (SELECT max(coalesce(l_discount, 0.0)) AS dmax FROM lineitem)
SELECT l_orderkey, l_linenumber,
  round(l_extendedprice * (1 - CASE WHEN dmax > 1.5 THEN coalesce(l_discount, 0.0) / 100.0 ELSE coalesce(l_discount, 0.0) END), 2) AS net_revenue
FROM lineitem, m
""")
def feature_net_revenue(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return FT.add_net_revenue(li, "l_extendedprice", "l_discount").select("l_orderkey", "l_linenumber", "net_revenue")


@register("feature_net_revenue_percent", """
WITH m AS (SELECT max(coalesce(l_discount * 100, 0.0)) AS dmax FROM lineitem)
SELECT l_orderkey, l_linenumber,
  round(l_extendedprice * (1 - CASE WHEN dmax > 1.5 THEN coalesce(l_discount * 100, 0.0) / 100.0 ELSE coalesce(l_discount * 100, 0.0) END), 2) AS net_revenue
FROM lineitem, m
""")
def feature_net_revenue_percent(spark, sf_dir):
    # The same discounts written as whole percents are detected and rescaled.
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice",
                                                (F.col("l_discount") * 100).alias("discount_pct"))
    return FT.add_net_revenue(li, "l_extendedprice", "discount_pct").select("l_orderkey", "l_linenumber", "net_revenue")


@register("feature_revenue_per_unit", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 THEN round(l_extendedprice / l_quantity, 2) END AS revenue_per_unit
FROM lineitem
""")
def feature_revenue_per_unit(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return FT.add_revenue_per_unit(li, "l_extendedprice", "l_quantity").select("l_orderkey", "l_linenumber", "revenue_per_unit")


@register("feature_age_band", """
SELECT p_partkey, CASE WHEN p_size IS NULL OR p_size <= 0 THEN NULL WHEN p_size <= 24 THEN 'Under 25'
  WHEN p_size <= 34 THEN '25-34' WHEN p_size <= 44 THEN '35-44' WHEN p_size <= 54 THEN '45-54'
  WHEN p_size <= 64 THEN '55-64' WHEN p_size <= 200 THEN '65+' END AS age_band
FROM part
""")
def feature_age_band(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", "p_size")
    return FT.add_age_band(p, "p_size").select("p_partkey", "age_band")


@register("feature_custom_bands", """
SELECT o_orderkey, CASE WHEN o_totalprice <= 50000 THEN 'low' WHEN o_totalprice <= 200000 THEN 'mid' ELSE 'high' END AS order_band
FROM orders
""")
def feature_custom_bands(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    bands = [{"upto": 200000, "label": "mid"}, {"upto": 50000, "label": "low"}]
    return FT.add_custom_bands(o, "order_band", "o_totalprice", bands, "high").select("o_orderkey", "order_band")


@register("feature_rule_band", """
SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN NULL WHEN o_totalprice >= 300000 THEN 'Large order'
  ELSE 'Not Large order' END AS large_order
FROM orders
""")
def feature_rule_band(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    df, name = FT.add_rule_band(o, "Large order", "o_totalprice", ">=", 300000.0)
    return df.select("o_orderkey", name)
