"""Verification-core queries: significance (G1-G7), confounding (X1-X5) and
attribution (T1-T5) on orders, lineitem, events, labels x documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritable.functions.exprs import rnd
from veritable.operators import attribution as T
from veritable.operators import confound as X
from veritable.operators import profile as P
from veritable.operators import significance as G
from veritable.queries.registry import register
from veritable.sources.tables import load


def _cmp_out(df):
    return df.select("left", "right", rnd("mean_left", 4).alias("mean_left"), rnd("mean_right", 4).alias("mean_right"),
                     "n_left", "n_right", rnd("difference", 4).alias("difference"), rnd("relative", 6).alias("relative"),
                     rnd("low", 4).alias("low"), rnd("high", 4).alias("high"), "verdict", "method")


def _cmp_sql(table: str, group: str, measure: str, left_sql: str, right_sql: str) -> str:
    return f"""
WITH s AS (SELECT CAST({group} AS VARCHAR) AS g, count(*) AS n, avg({measure}) AS m, coalesce(var_samp({measure}), 0) AS v
           FROM {table} WHERE {group} IS NOT NULL AND {measure} IS NOT NULL GROUP BY 1),
p AS (SELECT l.g AS "left", r.g AS "right", l.m AS ml, r.m AS mr, l.n AS nl, r.n AS nr, l.v AS vl, r.v AS vr,
             l.m - r.m AS d, CASE WHEN r.m <> 0 THEN abs(r.m) ELSE abs(l.m) END AS base,
             sqrt(l.v / l.n + r.v / r.n) AS se
      FROM s l, s r WHERE l.g = ({left_sql}) AND r.g = ({right_sql})),
q AS (SELECT *, CASE WHEN base <> 0 THEN d / base ELSE 0 END AS rel, d - 1.96 * se AS lo, d + 1.96 * se AS hi FROM p)
SELECT "left", "right", round(ml, 4) AS mean_left, round(mr, 4) AS mean_right, CAST(nl AS BIGINT) AS n_left,
  CAST(nr AS BIGINT) AS n_right, round(d, 4) AS difference, round(rel, 6) AS relative,
  CASE WHEN nl < 20 OR nr < 20 THEN NULL ELSE round(lo, 4) END AS low,
  CASE WHEN nl < 20 OR nr < 20 THEN NULL ELSE round(hi, 4) END AS high,
  CASE WHEN nl < 20 OR nr < 20 THEN 'too_few' WHEN abs(rel) < 0.05 THEN 'noise'
       WHEN least(nl, nr) >= 200 AND (lo > 0 OR hi < 0) AND hi - lo <= abs(d) * 0.8 THEN 'solid' ELSE 'undecided' END AS verdict,
  CASE WHEN nl < 20 OR nr < 20 THEN NULL ELSE 'normal' END AS method
FROM q
"""


@register("sig_compare", _cmp_sql("orders", "o_orderpriority", "o_totalprice", "'1-URGENT'", "'5-LOW'"))
def sig_compare(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return _cmp_out(G.compare_groups(o, "o_orderpriority", "o_totalprice", "1-URGENT", "5-LOW"))


@register("sig_compare_solid", _cmp_sql(
    "(SELECT CASE WHEN o_totalprice >= 250000 THEN 'large' ELSE 'small' END AS size_band, o_totalprice FROM orders)",
    "size_band", "o_totalprice", "'large'", "'small'"))
def sig_compare_solid(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_totalprice") >= 250000, "large").otherwise("small").alias("size_band"), "o_totalprice")
    return _cmp_out(G.compare_groups(o, "size_band", "o_totalprice", "large", "small"))


@register("sig_extremes", _cmp_sql(
    "orders", "o_orderpriority", "o_totalprice",
    "SELECT g FROM s ORDER BY m DESC, g LIMIT 1", "SELECT g FROM s ORDER BY m ASC, g DESC LIMIT 1"))
def sig_extremes(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return _cmp_out(G.compare_extremes(o, "o_orderpriority", "o_totalprice"))


@register("sig_extremes_bootstrap")
def sig_extremes_bootstrap(spark, sf_dir):
    # events: signup vs purchase is undecided by the normal rule, so the
    # bootstrap decides (no DuckDB twin of the hash stream: rows-only; checked
    # against a plain loop and a NumPy bootstrap in tests/).
    e = load(spark, sf_dir, "events")
    return _cmp_out(G.compare_extremes(e, "event_type", "value"))


@register("sig_wilson", """
WITH g AS (SELECT d.source AS "group", count_if(l.quality = 1) AS c, count(*) AS t
           FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1),
w AS (SELECT *, CAST(c AS DOUBLE) / t AS p, 1 + 1.96 * 1.96 / t AS den FROM g)
SELECT "group", CAST(c AS BIGINT) AS count, CAST(t AS BIGINT) AS total, round(p, 6) AS share,
  round(greatest(0.0, ((p + 1.96 * 1.96 / (2 * t)) / den) - 1.96 * sqrt(p * (1 - p) / t + 1.96 * 1.96 / (4 * t * t)) / den), 6) AS low,
  round(least(1.0, ((p + 1.96 * 1.96 / (2 * t)) / den) + 1.96 * sqrt(p * (1 - p) / t + 1.96 * 1.96 / (4 * t * t)) / den), 6) AS high
FROM w
""")
def sig_wilson(spark, sf_dir):
    labels, docs = load(spark, sf_dir, "labels"), load(spark, sf_dir, "documents").select("doc_id", "source")
    j = labels.join(docs, "doc_id")
    s = G.share_by_group(j, "source", F.col("quality") == 1)
    return s.select("group", "count", "total", rnd("share", 6).alias("share"), rnd("low", 6).alias("low"),
                    rnd("high", 6).alias("high"))


@register("sig_enough_rows", """
SELECT count(*) >= 2 AND coalesce(min(c), 0) >= 20 AS enough, CAST(count(*) AS BIGINT) AS groups,
       CAST(min(c) AS BIGINT) AS smallest
FROM (SELECT o_orderpriority, count(*) AS c FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)
""")
def sig_enough_rows(spark, sf_dir):
    return G.enough_rows(load(spark, sf_dir, "orders"), "o_orderpriority")


# --- confounding --------------------------------------------------------------

# What X3 finds on lineitem against l_returnflag and l_extendedprice, fewest levels first (the oracles list them).
CONDITIONS = ["l_linestatus", "l_linenumber", "l_tax", "l_discount"]
CONDITION_ORDER = ", ".join(f"('{c}', {i})" for i, c in enumerate(CONDITIONS))


def conditions(li):
    return X.choose_conditions(li, "l_returnflag", "l_extendedprice")


def _q(v: str, raw: bool) -> str:
    return v if raw else f"'{v}'"


def _cells_sql(left: str, right: str, raw: bool = False) -> str:
    parts = [f"""SELECT '{c}' AS condition, CAST({c} AS VARCHAR) AS level, l_returnflag AS g,
  avg(l_extendedprice) AS m, count(*) AS n FROM lineitem
  WHERE l_returnflag IN ({_q(left, raw)}, {_q(right, raw)}) AND l_extendedprice IS NOT NULL AND {c} IS NOT NULL GROUP BY 1, 2, 3"""
             for c in CONDITIONS]
    return " UNION ALL ".join(parts)


def _decompose_sql(left: str, right: str, raw: bool = False) -> str:
    return f"""
WITH cells AS ({_cells_sql(left, right, raw)}),
sh AS (SELECT a.condition, a.level, a.m AS ml, a.n AS cl, b.m AS mr, b.n AS cr
       FROM cells a JOIN cells b ON a.condition = b.condition AND a.level = b.level AND a.g = {_q(left, raw)} AND b.g = {_q(right, raw)}),
w AS (SELECT *, sum(cl) OVER (PARTITION BY condition) AS tl, sum(cr) OVER (PARTITION BY condition) AS tr,
             count(*) OVER (PARTITION BY condition) AS levels,
             sum(ml * cl) OVER (PARTITION BY condition) / sum(cl) OVER (PARTITION BY condition)
             - sum(mr * cr) OVER (PARTITION BY condition) / sum(cr) OVER (PARTITION BY condition) AS overall FROM sh),
v AS (SELECT *, cl >= 15 AND cr >= 15 AS votes,
             cl >= 15 AND cr >= 15 AND sign(overall) <> 0 AND sign(ml - mr) = -sign(overall) AS rev FROM w WHERE levels >= 2),
d AS (SELECT condition, any_value(overall) AS overall_difference,
             sum(((CAST(cl AS DOUBLE) / tl) + (CAST(cr AS DOUBLE) / tr)) / 2 * (ml - mr)) AS within_difference,
             sum(((CAST(cl AS DOUBLE) / tl) - (CAST(cr AS DOUBLE) / tr)) * (ml + mr) / 2) AS mix_difference,
             sum(CASE WHEN votes THEN cl + cr ELSE 0 END) AS tw, sum(CASE WHEN rev THEN cl + cr ELSE 0 END) AS rw,
             list_sort(list(level) FILTER (WHERE rev)) AS reversed_levels, any_value(levels) AS shared_levels
      FROM v GROUP BY condition)
SELECT condition, round(overall_difference, 4) AS overall_difference, round(within_difference, 4) AS within_difference,
  round(mix_difference, 4) AS mix_difference,
  round(CASE WHEN tw > 0 THEN CAST(rw AS DOUBLE) / tw ELSE 0 END, 6) AS reversed_share,
  round(CASE WHEN overall_difference <> 0 THEN abs(mix_difference) / abs(overall_difference) ELSE 0 END, 6) AS mix_share,
  array_to_string(reversed_levels, ',') AS reversed_levels, CAST(shared_levels AS BIGINT) AS shared_levels
FROM d
"""


def _dec_out(df):
    return df.select("condition", rnd("overall_difference", 4).alias("overall_difference"),
                     rnd("within_difference", 4).alias("within_difference"), rnd("mix_difference", 4).alias("mix_difference"),
                     rnd("reversed_share", 6).alias("reversed_share"), rnd("mix_share", 6).alias("mix_share"),
                     F.array_join("reversed_levels", ",").alias("reversed_levels"), "shared_levels")


def _levels_sql(columns: list[tuple[str, int]]) -> str:
    one = """SELECT '{c}' AS column_name, count(DISTINCT {c}) AS levels, {most} AS most, count(*) AS n FROM lineitem"""
    return " UNION ALL ".join(one.format(c=c, most=most) for c, most in columns)


@register("confound_conditions", f"""
SELECT column_name, levels FROM ({_levels_sql([("l_orderkey", 12), ("l_partkey", 12), ("l_suppkey", 12), ("l_linenumber", 12),
  ("l_quantity", 12), ("l_discount", 12), ("l_tax", 12), ("l_linestatus", 15), ("l_shipdate", 15)])})
WHERE levels BETWEEN 2 AND most AND n >= 15 * levels
""")
def confound_conditions(spark, sf_dir):
    facts = P.column_facts(load(spark, sf_dir, "lineitem"))
    return X.usable_conditions(facts, "l_returnflag", "l_extendedprice")


@register("attribution_dimensions", """
SELECT column_name FROM (SELECT 'o_orderstatus' AS column_name, count(DISTINCT o_orderstatus) AS n FROM orders
  UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders)
WHERE n BETWEEN 2 AND 40
""")
def attribution_dimensions(spark, sf_dir):
    return T.dimension_rows(P.profile_dataset(load(spark, sf_dir, "orders")), "o_totalprice", calendar=False)


@register("confound_decompose", _decompose_sql("R", "A"))
def confound_decompose(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    cells = X.cell_means(li, "l_returnflag", "l_extendedprice", conditions(li), "R", "A")
    return _dec_out(X.decompose(cells, "R", "A"))


@register("confound_cells", f"""
SELECT condition, level, g AS side, round(m, 4) AS mean, CAST(n AS BIGINT) AS count FROM ({_cells_sql("R", "N")})
""")
def confound_cells(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    cells = X.cell_means(li, "l_returnflag", "l_extendedprice", conditions(li), "R", "N")
    return cells.select("condition", "level", F.col("_g").alias("side"), rnd("mean", 4).alias("mean"),
                        F.col("cnt").cast("bigint").alias("count"))


@register("confound_check", f"""
WITH d AS ({_decompose_sql("R", "A")}),
o AS (SELECT * FROM (VALUES {CONDITION_ORDER}) AS t(condition, ord)),
k AS (SELECT d.*, o.ord, CASE WHEN reversed_share >= 0.6 AND reversed_levels <> '' THEN 'reversal'
                              WHEN mix_share >= 0.5 THEN 'mix' END AS kind FROM d JOIN o USING (condition))
SELECT condition, kind, overall_difference, within_difference, mix_difference, reversed_share, mix_share FROM k
WHERE kind IS NOT NULL
ORDER BY CASE WHEN kind = 'reversal' THEN 0 ELSE 1 END, CASE WHEN kind = 'reversal' THEN ord ELSE -mix_share END, ord
LIMIT 1
""")
def confound_check(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    best = X.check(li, "l_returnflag", "l_extendedprice", "R", "A", conditions(li))
    return best.select("condition", "kind", rnd("overall_difference", 4).alias("overall_difference"),
                       rnd("within_difference", 4).alias("within_difference"),
                       rnd("mix_difference", 4).alias("mix_difference"), rnd("reversed_share", 6).alias("reversed_share"),
                       rnd("mix_share", 6).alias("mix_share"))


TOP_FLAG = ("(SELECT l_returnflag FROM lineitem WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL "
            "GROUP BY 1 ORDER BY avg(l_extendedprice) DESC, l_returnflag LIMIT 1)")
BOTTOM_FLAG = ("(SELECT l_returnflag FROM lineitem WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL "
               "GROUP BY 1 ORDER BY avg(l_extendedprice) ASC, l_returnflag DESC LIMIT 1)")


@register("confound_check_extremes", f"""
WITH d AS ({_decompose_sql(TOP_FLAG, BOTTOM_FLAG, raw=True)}),
o AS (SELECT * FROM (VALUES {CONDITION_ORDER}) AS t(condition, ord)),
k AS (SELECT d.*, o.ord, CASE WHEN reversed_share >= 0.6 AND reversed_levels <> '' THEN 'reversal'
                              WHEN mix_share >= 0.5 THEN 'mix' END AS kind FROM d JOIN o USING (condition))
SELECT condition, kind, overall_difference, within_difference, mix_difference, reversed_share, mix_share FROM k
WHERE kind IS NOT NULL
ORDER BY CASE WHEN kind = 'reversal' THEN 0 ELSE 1 END, CASE WHEN kind = 'reversal' THEN ord ELSE -mix_share END, ord
LIMIT 1
""")
def confound_check_extremes(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    best = X.check_extremes(li, "l_returnflag", "l_extendedprice", conditions(li))
    return best.select("condition", "kind", rnd("overall_difference", 4).alias("overall_difference"),
                       rnd("within_difference", 4).alias("within_difference"),
                       rnd("mix_difference", 4).alias("mix_difference"), rnd("reversed_share", 6).alias("reversed_share"),
                       rnd("mix_share", 6).alias("mix_share"))


# --- attribution --------------------------------------------------------------

def dims(orders):
    """T4 on orders: o_orderstatus and o_orderpriority (the oracles list them)."""
    return T.choose_dimensions(orders, "o_totalprice", calendar=False)


def _breakdown_sql(lv: str) -> str:
    return f"""
lv2 AS (SELECT *, count(*) OVER (PARTITION BY dimension) AS nlev FROM ({lv})),
c AS (SELECT dimension, level, after, before, after - before AS change, (after - before) / total AS share, total
      FROM lv2 WHERE nlev >= 2 AND after - before <> 0),
r AS (SELECT *, sum(CASE WHEN abs(share) >= 0.03 THEN 1 ELSE 0 END) OVER (PARTITION BY dimension
        ORDER BY abs(change) DESC, level ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigrank FROM c),
k AS (SELECT *, abs(share) >= 0.03 AND bigrank <= 5 AS kept FROM r),
rws AS (SELECT dimension, CAST(bigrank AS INTEGER) AS position, level AS label, change, share, before, after FROM k WHERE kept
  UNION ALL
  SELECT dimension, 6, 'everything else (' || CAST(count(*) AS VARCHAR) || ' groups)', sum(change),
         sum(change) / any_value(total), sum(before), sum(after) FROM k WHERE NOT kept GROUP BY dimension),
conc AS (SELECT dimension, max(abs(share)) AS concentration FROM k WHERE kept GROUP BY dimension)
SELECT rws.dimension, position, label, round(change, 2) AS change, round(share, 6) AS share, round(before, 2) AS before,
       round(after, 2) AS after, round(coalesce(conc.concentration, 0.0), 6) AS concentration
FROM rws LEFT JOIN conc ON rws.dimension = conc.dimension
"""


ATTR_BASE = """base AS (SELECT strftime(o_orderdate, '%Y-%m') AS _period, coalesce(o_totalprice, 0.0) AS _v,
    coalesce(CAST(o_orderstatus AS VARCHAR), 'not recorded') AS o_orderstatus,
    coalesce(CAST(o_orderpriority AS VARCHAR), 'not recorded') AS o_orderpriority
  FROM orders WHERE o_orderdate IS NOT NULL),
totals AS (SELECT _period AS period, sum(_v) AS total FROM base GROUP BY 1),
st AS (SELECT avg(total) AS m, count(*) AS n, sum(total) AS s FROM totals),
ch AS (SELECT period, total AS period_value, (st.s - total) / (st.n - 1) AS baseline_value, st.n AS periods
       FROM totals, st ORDER BY abs(total - st.m) DESC, period LIMIT 1),
summ AS (SELECT *, period_value - baseline_value AS change FROM ch WHERE periods >= 3 AND period_value - baseline_value <> 0)"""


@register("attribution_summary", f"""
WITH {ATTR_BASE}
SELECT period, round(period_value, 2) AS period_value, round(baseline_value, 2) AS baseline_value,
       round(change, 2) AS change, CAST(periods AS BIGINT) AS periods FROM summ
""")
def attribution_summary(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    summary, _ = T.explain(orders, "o_orderdate", "o_totalprice", dims(orders))
    return summary.select("period", rnd("period_value", 2).alias("period_value"),
                          rnd("baseline_value", 2).alias("baseline_value"), rnd("change", 2).alias("change"),
                          F.col("periods").cast("bigint").alias("periods"))


def _contrib_out(df):
    return df.select("dimension", F.col("position").cast("int").alias("position"), "label", rnd("change", 2).alias("change"),
                     rnd("share", 6).alias("share"), rnd("before", 2).alias("before"), rnd("after", 2).alias("after"),
                     rnd("concentration", 6).alias("concentration"))


_PERIOD_LV = """SELECT dimension, level, sum(CASE WHEN _period = summ.period THEN _v ELSE 0 END) AS after,
    sum(CASE WHEN _period <> summ.period THEN _v * (1.0 / (summ.periods - 1)) ELSE 0 END) AS before, any_value(summ.change) AS total
  FROM (SELECT _period, _v, 'o_orderstatus' AS dimension, o_orderstatus AS level FROM base
        UNION ALL SELECT _period, _v, 'o_orderpriority', o_orderpriority FROM base) long, summ
  GROUP BY dimension, level, summ.periods"""


@register("attribution_period", f"WITH {ATTR_BASE},\n{_breakdown_sql(_PERIOD_LV)}")
def attribution_period(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    _, contrib = T.explain(orders, "o_orderdate", "o_totalprice", dims(orders))
    return _contrib_out(contrib)


@register("attribution_rank", f"""
WITH {ATTR_BASE},
bd AS ({_breakdown_sql(_PERIOD_LV).replace("lv2 AS", "WITH lv2 AS", 1)})
SELECT DISTINCT dimension, concentration FROM bd
""")
def attribution_rank(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    _, contrib = T.explain(orders, "o_orderdate", "o_totalprice", dims(orders))
    return T.rank_dimensions(contrib).select("dimension", rnd("concentration", 6).alias("concentration"))


_GAP_LV = """SELECT dimension, level, sum(CASE WHEN g = 'F' THEN _v ELSE 0 END) AS after,
    sum(CASE WHEN g = 'O' THEN _v ELSE 0 END) AS before, any_value(summ.change) AS total
  FROM (SELECT g, _v, 'o_orderpriority' AS dimension, o_orderpriority AS level FROM gb) long, summ
  GROUP BY dimension, level"""

GAP_BASE = """gb AS (SELECT CAST(o_orderstatus AS VARCHAR) AS g, coalesce(o_totalprice, 0.0) AS _v,
    coalesce(CAST(o_orderpriority AS VARCHAR), 'not recorded') AS o_orderpriority FROM orders
  WHERE o_orderstatus IN ('F', 'O')),
summ AS (SELECT 'F' AS "left", 'O' AS "right", sum(CASE WHEN g = 'F' THEN _v ELSE 0 END) AS left_value,
  sum(CASE WHEN g = 'O' THEN _v ELSE 0 END) AS right_value,
  sum(CASE WHEN g = 'F' THEN _v ELSE 0 END) - sum(CASE WHEN g = 'O' THEN _v ELSE 0 END) AS change FROM gb)"""


@register("attribution_group_gap", f"WITH {GAP_BASE},\n{_breakdown_sql(_GAP_LV)}")
def attribution_group_gap(spark, sf_dir):
    _, contrib = T.explain_group_gap(load(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", "F", "O",
                                     ["o_orderstatus", "o_orderpriority"])
    return _contrib_out(contrib)
