"""Join queries (J1-J5, S5) on orders x customer, customer x nation x region,
nation x customer and lineitem x part."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritable.functions.exprs import with_scalars
from veritable.operators import joining as J
from veritable.queries.registry import register
from veritable.sources.tables import load

ORDERS_ROLES = {"o_orderkey": "identifier", "o_custkey": "identifier", "o_orderstatus": "category",
                "o_totalprice": "measure", "o_orderdate": "datetime", "o_orderpriority": "category"}
CUSTOMER_ROLES = {"c_custkey": "identifier", "c_name": "identifier", "c_nationkey": "category",
                  "c_acctbal": "measure", "c_mktsegment": "category"}


def _key(col: str, numeric: bool) -> str:
    return f"CAST({col} AS DECIMAL(38,10))" if numeric else f"trim(CAST({col} AS VARCHAR))"


def pair_sql(lt: str, lc: str, rt: str, rc: str, numeric: bool) -> str:
    lk, rk = _key(lc, numeric), _key(rc, numeric)
    return f"""SELECT '{lc}' AS left_column, '{rc}' AS right_column,
  CASE WHEN count(l.k) > 0 THEN CAST(count(r.k) AS DOUBLE) / count(l.k) ELSE 0.0 END AS overlap,
  CAST(coalesce(sum(CASE WHEN r.k IS NOT NULL THEN l.c END), 0) AS BIGINT) AS matched_rows,
  CAST(sum(l.c) + coalesce(sum(CASE WHEN r.k IS NOT NULL THEN l.c * (r.c - 1) END), 0) AS BIGINT) AS expected_rows,
  CAST(sum(l.c) AS BIGINT) AS left_rows,
  (SELECT max(c) <= 1 FROM (SELECT {rk} AS k, count(*) AS c FROM {rt} WHERE {rc} IS NOT NULL GROUP BY 1)) AS right_unique
FROM (SELECT {lk} AS k, count(*) AS c FROM {lt} GROUP BY 1) l
LEFT JOIN (SELECT {rk} AS k, count(*) AS c FROM {rt} WHERE {rc} IS NOT NULL GROUP BY 1) r ON l.k = r.k"""


def _round_stats(df):
    return df.select("left_column", "right_column", F.round("overlap", 6).alias("overlap"), "matched_rows",
                     "expected_rows", "left_rows", "right_unique")


def _overlap_sql(lt, lc, rt, rc, numeric=True):
    return (f"SELECT left_column, right_column, round(overlap, 6) AS overlap, matched_rows, expected_rows, "
            f"left_rows, right_unique FROM ({pair_sql(lt, lc, rt, rc, numeric)})")


@register("join_overlap", _overlap_sql("orders", "o_custkey", "customer", "c_custkey"))
def join_overlap(spark, sf_dir):
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    return _round_stats(J.value_overlap(o, "o_custkey", c, "c_custkey"))


@register("join_overlap_nation", _overlap_sql("customer", "c_nationkey", "nation", "n_nationkey"))
def join_overlap_nation(spark, sf_dir):
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    return _round_stats(J.value_overlap(c, "c_nationkey", n, "n_nationkey"))


CANDIDATE_PAIRS = [("o_orderkey", "c_custkey", True), ("o_orderkey", "c_nationkey", True),
                   ("o_custkey", "c_custkey", True), ("o_custkey", "c_nationkey", True),
                   ("o_orderpriority", "c_name", False), ("o_orderpriority", "c_mktsegment", False)]


def _candidates_sql() -> str:
    union = "\nUNION ALL\n".join(pair_sql("orders", lc, "customer", rc, num) for lc, rc, num in CANDIDATE_PAIRS)
    agree = " OR ".join(
        f"(left_column = '{lc}' AND right_column = '{rc}')" for lc, rc, _ in CANDIDATE_PAIRS
        if J.names_agree(lc, rc)
    ) or "false"
    return f"""
SELECT left_column, right_column, round(overlap, 6) AS overlap, matched_rows, expected_rows, left_rows, right_unique,
  round(CAST(expected_rows AS DOUBLE) / left_rows, 6) AS fan_out,
  right_unique AND CAST(expected_rows AS DOUBLE) / left_rows <= 1.05 AS safe,
  round(overlap + CASE WHEN right_unique THEN 0.25 ELSE 0 END + CASE WHEN {agree} THEN 0.15 ELSE 0 END, 6) AS score
FROM ({union}) WHERE overlap >= 0.5
"""


@register("join_candidates", _candidates_sql())
def join_candidates(spark, sf_dir):
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    od = J.distinct_counts(o, [k for k, r in ORDERS_ROLES.items() if r not in J.NON_KEY_ROLES])
    cd = J.distinct_counts(c, [k for k, r in CUSTOMER_ROLES.items() if r not in J.NON_KEY_ROLES])
    cands = J.find_candidates(o, c, ORDERS_ROLES, CUSTOMER_ROLES, od, cd)
    return cands.select("left_column", "right_column", F.round("overlap", 6).alias("overlap"), "matched_rows",
                        "expected_rows", "left_rows", "right_unique", F.round("fan_out", 6).alias("fan_out"),
                        "safe", F.round("score", 6).alias("score"))


@register("join_fanout", """
SELECT CAST(sum(l.c) + coalesce(sum(CASE WHEN r.k IS NOT NULL THEN l.c * (r.c - 1) END), 0) AS BIGINT) AS expected_rows,
       (SELECT CAST(count(*) AS BIGINT) FROM nation n LEFT JOIN customer c ON n.n_nationkey = c.c_nationkey) AS actual_rows
FROM (SELECT n_nationkey AS k, count(*) AS c FROM nation GROUP BY 1) l
LEFT JOIN (SELECT c_nationkey AS k, count(*) AS c FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1) r ON l.k = r.k
""")
def join_fanout(spark, sf_dir):
    n, c = load(spark, sf_dir, "nation"), load(spark, sf_dir, "customer")
    est = J.value_overlap(n, "n_nationkey", c, "c_nationkey").select("expected_rows")
    actual = J.apply_join(n, c, "n_nationkey", "c_nationkey").agg(F.count(F.lit(1)).cast("bigint").alias("actual_rows"))
    return with_scalars(est, actual)


@register("join_apply", """
SELECT o.o_orderkey, o.o_custkey, c.c_name, c.c_acctbal, c.c_mktsegment, c.c_nationkey
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
""")
def join_apply(spark, sf_dir):
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    j = J.apply_join(o, c, "o_custkey", "c_custkey")
    return j.select("o_orderkey", "o_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")


@register("join_apply_lineitem_part", """
SELECT l.l_orderkey, l.l_linenumber, p.p_brand, p.p_retailprice
FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
""")
def join_apply_lineitem_part(spark, sf_dir):
    li, p = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    return J.apply_join(li, p, "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "p_brand", "p_retailprice")


@register("join_large_keys", """
SELECT o.o_orderkey, c.c_name FROM orders o
LEFT JOIN customer c ON o.o_custkey + 9007199254740992 = c.c_custkey + 9007199254740993
""")
def join_large_keys(spark, sf_dir):
    """Keys beyond 2^53, one apart on the two sides: doubles would join neighbours."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + F.lit(2**53)).alias("k"))
    c = load(spark, sf_dir, "customer").select((F.col("c_custkey") + F.lit(2**53 + 1)).alias("ck"), "c_name")
    return J.apply_join(o, c, "k", "ck").select("o_orderkey", "c_name")


@register("join_double_keys", """
SELECT l.l_orderkey, l.l_linenumber, d.n FROM lineitem l
LEFT JOIN (SELECT o_totalprice * 1e30 AS k, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) d
  ON (SELECT o_totalprice FROM orders o WHERE o.o_orderkey = l.l_orderkey) * 1e30 = d.k
""")
def join_double_keys(spark, sf_dir):
    """Double keys far outside what a fixed decimal scale can hold."""
    o = load(spark, sf_dir, "orders")
    k = (F.col("o_totalprice") * F.lit(1e30)).alias("k")
    counts = o.where("o_orderkey % 2 = 0").groupBy(k).agg(F.count(F.lit(1)).alias("n"))
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    rows = li.join(o.select("o_orderkey", k), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return J.apply_join(rows, counts.withColumnRenamed("k", "key"), "k", "key").select("l_orderkey", "l_linenumber", "n")


@register("join_multi_table", """
SELECT c.c_custkey, n.n_name, r.r_name
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
""")
def join_multi_table(spark, sf_dir):
    c, n, r = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    j = J.apply_join(J.apply_join(c, n, "c_nationkey", "n_nationkey"), r, "n_regionkey", "r_regionkey")
    return j.select("c_custkey", "n_name", "r_name")


@register("join_choose_base", """
SELECT name AS base_table FROM (
  SELECT 'orders' AS name, count(*) AS n, 1 AS m FROM orders
  UNION ALL SELECT 'customer', count(*), 1 FROM customer
  UNION ALL SELECT 'lineitem', count(*), 4 FROM lineitem)
ORDER BY n DESC, m DESC LIMIT 1
""")
def join_choose_base(spark, sf_dir):
    tables = {"orders": (load(spark, sf_dir, "orders"), 1), "customer": (load(spark, sf_dir, "customer"), 1),
              "lineitem": (load(spark, sf_dir, "lineitem"), 4)}
    counts = None
    for name, (df, measures) in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("base_table"), "n",
                                                           F.lit(measures).alias("m"))
        counts = row if counts is None else counts.unionByName(row)
    return counts.orderBy(F.col("n").desc(), F.col("m").desc()).limit(1).select("base_table")
