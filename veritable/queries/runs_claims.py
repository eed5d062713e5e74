"""Run comparison (V1-V4, J6, S8), claims (M1-M6) and domain (U1, U2, U5) queries."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from veritable.functions.exprs import is_numeric_type, rnd
from veritable.operators import claims as M
from veritable.operators import compare as V
from veritable.operators import domain as U
from veritable.operators import kpis as K
from veritable.queries.registry import register
from veritable.queries.sqlparts import quote_list
from veritable.sources.tables import TABLES, load

SPLIT = "1997-01-01"
ORDERS_KPI = K.KpiColumns(revenue="o_totalprice", entity="o_custkey", date="o_orderdate", money_scale=2)


def _halves(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.filter(F.col("o_orderdate") < F.lit(SPLIT).cast("timestamp")), o.filter(F.col("o_orderdate") >= F.lit(SPLIT).cast("timestamp"))


@register("run_period", f"""
SELECT 'before' AS run, strftime(min(o_orderdate), '%Y-%m-%d') AS start, strftime(max(o_orderdate), '%Y-%m-%d') AS "end",
  round(greatest(floor(epoch_us(max(o_orderdate) - min(o_orderdate)) / 86400000000.0), 1) / 30.44, 2) AS months
FROM orders WHERE o_orderdate < TIMESTAMP '{SPLIT}'
UNION ALL
SELECT 'now', strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d'),
  round(greatest(floor(epoch_us(max(o_orderdate) - min(o_orderdate)) / 86400000000.0), 1) / 30.44, 2)
FROM orders WHERE o_orderdate >= TIMESTAMP '{SPLIT}'
""")
def run_period(spark, sf_dir):
    before, now = _halves(spark, sf_dir)
    return V.period_of(before, "o_orderdate").select(F.lit("before").alias("run"), "*").unionByName(
        V.period_of(now, "o_orderdate").select(F.lit("now").alias("run"), "*"))


def _run_kpi_sql(cond: str) -> str:
    return f"""SELECT 'record_count' AS kpi_id, CAST(count(*) AS DOUBLE) AS value, 'count' AS unit FROM orders WHERE {cond}
  UNION ALL SELECT 'total_revenue', CAST(sum(CAST(o_totalprice AS DECIMAL(38,2))) AS DOUBLE), 'money' FROM orders WHERE {cond}
  UNION ALL SELECT 'average_order_value', avg(o_totalprice), 'money' FROM orders WHERE {cond}
  UNION ALL SELECT 'active_customers', CAST(count(DISTINCT o_custkey) AS DOUBLE), 'count' FROM orders WHERE {cond}"""


def _months_sql(cond: str) -> str:
    return (f"(SELECT round(greatest(floor(epoch_us(max(o_orderdate) - min(o_orderdate)) / 86400000000.0), 1) / 30.44, 2) "
            f"FROM orders WHERE {cond})")


RUN_COMPARE_SQL = f"""
WITH n AS ({_run_kpi_sql(f"o_orderdate >= TIMESTAMP '{SPLIT}'")}),
b AS ({_run_kpi_sql(f"o_orderdate < TIMESTAMP '{SPLIT}'")}),
m AS (SELECT {_months_sql(f"o_orderdate >= TIMESTAMP '{SPLIT}'")} AS mn, {_months_sql(f"o_orderdate < TIMESTAMP '{SPLIT}'")} AS mb),
names AS (SELECT * FROM (VALUES ('record_count', 'Number of records'), ('total_revenue', 'Total revenue'),
  ('average_order_value', 'Average order value'), ('active_customers', 'Active customers')) AS t(kpi_id, name)),
j AS (SELECT n.kpi_id, names.name, n.unit, n.value AS v_now, b.value AS v_before,
        NOT (abs(mn - mb) / mb <= 0.25) AND n.unit <> '%'
          AND (lower(names.name) LIKE '%total%' OR lower(names.name) LIKE '%number of%' OR lower(names.name) LIKE '%units%'
               OR lower(names.name) LIKE '%count%' OR lower(names.name) LIKE '%customers%') AS per_period,
        abs(mn - mb) / mb <= 0.25 AS comparable_periods, mn, mb
      FROM n JOIN b USING (kpi_id) JOIN names USING (kpi_id), m),
c AS (SELECT kpi_id, name, unit, CASE WHEN per_period THEN v_now / mn ELSE v_now END AS now,
        CASE WHEN per_period THEN v_before / mb ELSE v_before END AS before, per_period, comparable_periods FROM j)
SELECT kpi_id, name, unit, round(now, 4) AS now, round(before, 4) AS before, per_period, comparable_periods,
  round(now - before, 4) AS difference, round(CASE WHEN before <> 0 THEN (now - before) / abs(before) ELSE 0 END, 6) AS relative,
  abs(CASE WHEN before <> 0 THEN (now - before) / abs(before) ELSE 0 END) >= 0.05 AS material,
  CASE WHEN now - before > 0 THEN 'up' ELSE 'down' END AS direction
FROM c
"""


def _compare(spark, sf_dir):
    before, now = _halves(spark, sf_dir)
    return V.compare_runs(K.scalar_kpis(now, ORDERS_KPI), K.scalar_kpis(before, ORDERS_KPI),
                          V.period_of(now, "o_orderdate"), V.period_of(before, "o_orderdate"))


@register("run_compare", RUN_COMPARE_SQL)
def run_compare(spark, sf_dir):
    c = _compare(spark, sf_dir)
    return c.select("kpi_id", "name", "unit", rnd("now", 4).alias("now"), rnd("before", 4).alias("before"),
                    "per_period", "comparable_periods", rnd("difference", 4).alias("difference"),
                    rnd("relative", 6).alias("relative"), "material", "direction")


@register("run_change_findings", f"""
WITH c AS ({RUN_COMPARE_SQL})
SELECT name || ' has ' || CASE WHEN difference > 0 THEN 'risen' ELSE 'fallen' END || ' since the previous run' AS title,
       kpi_id, CASE WHEN abs(relative) >= 0.15 THEN 'high' ELSE 'medium' END AS confidence
FROM c WHERE material
""")
def run_change_findings(spark, sf_dir):
    return V.change_findings(_compare(spark, sf_dir)).select("title", "kpi_id", "confidence")


def _catalog(spark, sf_dir):
    """The columns of every driver table that hold a value, found in its rows."""
    parts = [V.filled_columns(load(spark, sf_dir, t), t) for t in TABLES]
    return functools.reduce(lambda x, y: x.unionByName(y), parts)


@register("schema_fingerprint", f"""
SELECT table_name, substr(sha256(string_agg(lower(trim(column_name)), '|' ORDER BY lower(trim(column_name)))), 1, 16) AS fingerprint
FROM information_schema.columns WHERE table_name IN ({quote_list(TABLES)}) GROUP BY table_name
""")
def schema_fingerprint(spark, sf_dir):
    return _catalog(spark, sf_dir).groupBy("table_name").agg(V.fingerprint_expr(F.col("column_name")).alias("fingerprint"))


def _signals_sql() -> str:
    rows = ", ".join(f"({i}, '{fam}', '{tok}')" for i, (fam, toks) in enumerate(U.FAMILY_SIGNALS) for tok in toks)
    return f"SELECT * FROM (VALUES {rows}) AS s(family_order, family, signal)"


def _norm_sql(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


DOMAIN_SCORES_SQL = f"""
WITH cat AS (SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ({quote_list(TABLES)})),
hay AS (SELECT table_name, {_norm_sql("column_name")} AS token FROM cat
        UNION ALL SELECT DISTINCT table_name, {_norm_sql("table_name")} FROM cat),
sig AS ({_signals_sql()}),
hits AS (SELECT DISTINCT h.table_name, s.family, s.signal FROM hay h JOIN sig s ON contains(h.token, {_norm_sql("s.signal")})),
grid AS (SELECT DISTINCT c.table_name, s.family, s.family_order FROM cat c, sig s),
cnt AS (SELECT table_name, family, count(*) AS score FROM hits GROUP BY 1, 2)
SELECT g.table_name, g.family, g.family_order, CAST(coalesce(cnt.score, 0) AS BIGINT) AS score
FROM grid g LEFT JOIN cnt USING (table_name, family)
"""


@register("domain_scores", f"SELECT table_name, family, score FROM ({DOMAIN_SCORES_SQL}) WHERE score > 0")
def domain_scores(spark, sf_dir):
    return U.domain_scores(_catalog(spark, sf_dir)).filter(F.col("score") > 0).select("table_name", "family", "score")


@register("domain_family", f"""
WITH s AS ({DOMAIN_SCORES_SQL}),
b AS (SELECT table_name, arg_min(family, (-score, family_order)) AS fam, max(score) AS score FROM s GROUP BY 1)
SELECT table_name, CASE WHEN score >= 2 THEN fam ELSE 'general' END AS family, score,
       CASE WHEN score < 2 THEN 'low' WHEN score >= 4 THEN 'high' ELSE 'medium' END AS confidence
FROM b
""")
def domain_family(spark, sf_dir):
    return U.infer_family(U.domain_scores(_catalog(spark, sf_dir))).select("table_name", "family", "score", "confidence")


@register("domain_row_subject", f"""
WITH cat AS (SELECT table_name, string_agg(lower(column_name), ' ') AS names FROM information_schema.columns
             WHERE table_name IN ({quote_list(TABLES)}) GROUP BY 1),
kw AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{subj}', '{kw}')" for i, (kws, subj) in enumerate(U.SUBJECT_SIGNALS) for kw in kws)})
       AS k(subject_order, subject, keyword)),
cnt AS (SELECT table_name, subject_order, subject, count(*) AS hits FROM cat JOIN kw ON contains(cat.names, kw.keyword)
        GROUP BY 1, 2, 3),
b AS (SELECT table_name, arg_min(subject, (-hits, subject_order)) AS subject, max(hits) AS hits FROM cnt GROUP BY 1)
SELECT cat.table_name, coalesce(b.subject, 'one business record') AS subject,
       CASE WHEN b.hits >= 2 THEN 'high' WHEN b.hits >= 1 THEN 'medium' ELSE 'low' END AS confidence
FROM cat LEFT JOIN b USING (table_name)
""")
def domain_row_subject(spark, sf_dir):
    return U.row_subject(_catalog(spark, sf_dir))


# --- claims ---------------------------------------------------------------------

def _claims():
    return [
        M.Claim(kind="threshold", column="o_totalprice", operator=">", value=300000, label="Large orders", claim_id="large"),
        M.Claim(kind="threshold", column="o_totalprice", operator=">=", value=0, claim_id="all_nonnegative"),
        M.Claim(kind="threshold", column="o_totalprice", operator="<", value=-1, claim_id="none_negative"),
        M.Claim(kind="threshold", column="no_such_column", operator=">", value=1, claim_id="missing_column"),
        M.Claim(kind="exclusion", column="o_orderstatus", values=["p"], claim_id="exclude_p"),
        M.Claim(kind="exclusion", column="o_orderpriority", values=["6-never"], claim_id="exclude_never"),
        M.Claim(kind="peak_period", period="December", claim_id="peak_december"),
        M.Claim(kind="peak_period", period="Q3", column="o_totalprice", claim_id="peak_q3"),
    ]


CLAIMS_SQL = """
WITH t AS (
  SELECT 'large' AS claim_id, 'threshold' AS kind, count_if(o_totalprice > 300000) AS matching, count(o_totalprice) AS total FROM orders
  UNION ALL SELECT 'all_nonnegative', 'threshold', count_if(o_totalprice >= 0), count(o_totalprice) FROM orders
  UNION ALL SELECT 'none_negative', 'threshold', count_if(o_totalprice < -1), count(o_totalprice) FROM orders
  UNION ALL SELECT 'exclude_p', 'exclusion', count_if(lower(CAST(o_orderstatus AS VARCHAR)) IN ('p')), count(*) FROM orders
  UNION ALL SELECT 'exclude_never', 'exclusion', count_if(lower(CAST(o_orderpriority AS VARCHAR)) IN ('6-never')), count(*) FROM orders),
tt AS (SELECT claim_id, kind, CASE WHEN kind = 'threshold' THEN total > 0 ELSE true END AS testable,
         CASE WHEN kind = 'exclusion' THEN matching = 0 ELSE matching > 0 AND CAST(matching AS DOUBLE) / total <= 0.98 END AS h,
         CAST(matching AS BIGINT) AS matching, CAST(total AS BIGINT) AS total FROM t),
pm AS (SELECT month(o_orderdate) AS k, sum(o_totalprice) AS total FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
pq AS (SELECT quarter(o_orderdate) AS k, sum(o_totalprice) AS total FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
peaks AS (
  SELECT 'peak_december' AS claim_id, count(*) AS groups, arg_min(k, (-total, k)) AS peak, 12 AS expected,
         ['January','February','March','April','May','June','July','August','September','October','November','December'] AS names FROM pm
  UNION ALL SELECT 'peak_q3', count(*), arg_min(k, (-total, k)), 3, ['Q1','Q2','Q3','Q4'] FROM pq)
SELECT claim_id, kind, testable, CASE WHEN testable THEN h ELSE true END AS holds, matching, total, CAST(NULL AS VARCHAR) AS observed FROM tt
UNION ALL
SELECT claim_id, 'peak_period', groups >= 3, CASE WHEN groups >= 3 THEN peak = expected ELSE true END,
       CAST(NULL AS BIGINT), CAST(groups AS BIGINT), names[peak] FROM peaks
UNION ALL
SELECT 'missing_column', 'threshold', false, true, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR)
"""


@register("claims_test", CLAIMS_SQL)
def claims_test(spark, sf_dir):
    return M.test_claims(load(spark, sf_dir, "orders"), _claims(), date="o_orderdate", measure="o_totalprice")


@register("claims_contradictions", f"""
SELECT * FROM ({CLAIMS_SQL}) WHERE testable AND NOT holds ORDER BY claim_id
""")
def claims_contradictions(spark, sf_dir):
    tests = M.test_claims(load(spark, sf_dir, "orders"), _claims(), date="o_orderdate", measure="o_totalprice")
    return M.contradictions(tests)


def _rules_of_orders(orders):
    """A rule in words for every order, in one of the three forms by its status, from the order's own figures."""
    price, month = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.date_format("o_orderdate", "MMMM")
    return orders.select(F.col("o_orderkey").cast("string").alias("statement_id"),
                         F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Thanks. Large orders are those with an o_totalprice above $"), price, F.lit(".")))
                         .when(F.col("o_orderstatus") == "O", F.concat(F.lit("Our busiest month is clearly "), month, F.lit(", as ever.")))
                         .otherwise(F.concat(F.lit("Please ignore all "), F.lower("o_orderpriority"), F.lit(" orders of "), month, F.lit("!"))).alias("text"))


@register("claims_extract", """
SELECT CAST(o_orderkey AS VARCHAR) AS statement_id,
  CASE o_orderstatus WHEN 'F' THEN 'threshold' WHEN 'O' THEN 'peak_period' ELSE 'exclusion' END AS kind,
  CASE o_orderstatus WHEN 'F' THEN 'o_totalprice' WHEN 'O' THEN NULL ELSE 'o_orderpriority' END AS column,
  CASE WHEN o_orderstatus = 'F' THEN '>' END AS operator,
  CASE o_orderstatus WHEN 'F' THEN CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) WHEN 'O' THEN NULL ELSE o_orderpriority END AS value,
  CASE WHEN o_orderstatus = 'F' THEN 'Large Orders' END AS label,
  CASE WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%B') END AS period
FROM orders
""")
def claims_extract(spark, sf_dir):
    """Rules written from the orders, and the user turns of conversations, which state none, read against the orders."""
    conv = load(spark, sf_dir, "conversations").filter(F.col("role") == "user").select(
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("statement_id"), "text")
    orders = load(spark, sf_dir, "orders")
    catalog = spark.createDataFrame([(f.name, is_numeric_type(f.dataType)) for f in orders.schema.fields], "column_name string, is_numeric boolean")
    return M.extract_claims(_rules_of_orders(orders).unionByName(conv), "text", catalog, M.low_cardinality_values(orders))


@register("domain_lead_facts", """
SELECT max(o_totalprice) AS largest, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
       arg_max(o_orderkey, o_totalprice) AS largest_place
FROM orders
""")
def domain_lead_facts(spark, sf_dir):
    # The largest value of the primary measure, its median and where the
    # largest one happened (the order key here).
    o = load(spark, sf_dir, "orders")
    f = U.lead_facts(o, "o_totalprice", "o_orderkey")
    return f.select("largest", F.round("median", 4).alias("median"), "largest_place")
