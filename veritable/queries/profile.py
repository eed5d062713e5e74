"""Profiling queries (R1-R12) on lineitem, customer, orders and events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veritable.functions.dates import MONTH_AND_DAY_WORDS
from veritable.operators import profile as P
from veritable.operators.profile_state import ProfileState
from veritable.queries.registry import register
from veritable.queries.sqlparts import histogram_sql, kinds_sql, quote_list
from veritable.session import ensure_checkpoint_dir
from veritable.sources.tables import load

LINEITEM_KINDS = {
    "l_orderkey": "numeric", "l_partkey": "numeric", "l_suppkey": "numeric", "l_linenumber": "numeric",
    "l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric", "l_tax": "numeric",
    "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time",
}
CUSTOMER_KINDS = {"c_custkey": "numeric", "c_name": "text", "c_nationkey": "numeric",
                  "c_acctbal": "numeric", "c_mktsegment": "text"}
EVENTS_KINDS = {"event_id": "numeric", "ts": "time", "user_id": "numeric", "event_type": "text",
                "value": "numeric", "props": "text"}


def _sql_id(p: str) -> str:
    return p.replace("'", "''")


def role_sql(table: str, kinds: dict[str, str], source: str | None = None) -> str:
    src = source or table
    pair_cols = ",\n".join(
        f"sum(CASE WHEN value IS NOT NULL AND lower(trim(value)) IN ({quote_list(pair)}) THEN 1 ELSE 0 END) AS pair_{i}"
        for i, pair in enumerate(P.BOOLEAN_TOKEN_PAIRS)
    )
    bool_like = " OR ".join(f"pair_{i} = dc" for i in range(len(P.BOOLEAN_TOKEN_PAIRS)))
    idp, datep = _sql_id(P.IDENTIFIER_PATTERN), _sql_id(P.DATE_NAME_PATTERN)
    moneyp, qtyp = _sql_id(P.MONEY_NAME_PATTERN), _sql_id(P.QUANTITY_NAME_PATTERN)
    return f"""
WITH h AS ({histogram_sql(src, list(kinds))}),
f AS (
  SELECT column_name, sum(cnt) AS n_rows,
         sum(CASE WHEN value IS NOT NULL THEN cnt ELSE 0 END) AS nn,
         sum(CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END) AS dc,
         sum(CASE WHEN value IS NOT NULL THEN length(value) * cnt ELSE 0 END) AS len_total,
         sum(CASE WHEN value IS NOT NULL AND regexp_full_match(trim(value), '\\d+(\\.\\d+)?') THEN cnt ELSE 0 END) AS bare,
         sum(CASE WHEN value IS NOT NULL AND lower(trim(value)) IN ({quote_list(MONTH_AND_DAY_WORDS)}) THEN cnt ELSE 0 END) AS cal,
         sum(CASE WHEN value IS NOT NULL AND try_cast(value AS TIMESTAMP) IS NOT NULL THEN cnt ELSE 0 END) AS parsed,
         {pair_cols}
  FROM h GROUP BY 1),
k AS ({kinds_sql(kinds)}),
g AS (SELECT f.*, k.kind, CAST(dc AS DOUBLE) / nn AS ratio,
             CAST(len_total AS DOUBLE) / nn AS avg_len,
             (dc BETWEEN 1 AND 2) AND ({bool_like}) AS bool_like,
             regexp_matches(f.column_name, '{idp}') AS id_like
      FROM f JOIN k USING (column_name))
SELECT column_name,
  CASE WHEN nn = 0 THEN 'unknown'
       WHEN dc = 1 THEN 'constant'
       WHEN lower(column_name) IN ({quote_list(P.CALENDAR_LABEL_NAMES)}) THEN 'category'
       WHEN kind = 'bool' OR bool_like THEN 'boolean'
       WHEN kind = 'time' THEN 'datetime'
       WHEN kind = 'numeric' THEN
         CASE WHEN id_like AND ratio >= {P.IDENTIFIER_UNIQUE_RATIO} THEN 'identifier'
              WHEN id_like AND dc <= {P.LOW_CARDINALITY_NUMERIC}
                   AND NOT regexp_matches(column_name, '{moneyp}')
                   AND NOT regexp_matches(column_name, '{qtyp}') THEN 'category'
              ELSE 'measure' END
       WHEN regexp_matches(column_name, '{datep}') AND CAST(bare AS DOUBLE) / nn <= 0.5
            AND CAST(cal AS DOUBLE) / nn <= 0.5 AND CAST(parsed AS DOUBLE) / nn >= {P.DATE_PARSE_THRESHOLD} THEN 'datetime'
       WHEN id_like AND ratio >= {P.IDENTIFIER_UNIQUE_RATIO} THEN 'identifier'
       WHEN ratio > 0.5 AND avg_len > 30 THEN 'text'
       WHEN ratio >= {P.IDENTIFIER_UNIQUE_RATIO} THEN 'identifier'
       WHEN dc <= 60 OR ratio < 0.35 THEN 'category'
       ELSE 'text' END AS role,
  CAST(n_rows - nn AS BIGINT) AS missing_count,
  round(CAST(n_rows - nn AS DOUBLE) / n_rows, 4) AS missing_rate,
  CAST(dc AS BIGINT) AS unique_count
FROM g
"""


def _roles(df, roles=None):
    return P.profile_dataset(df, roles).select("column_name", "role", "missing_count", "missing_rate", "unique_count")


@register("profile_roles_lineitem", role_sql("lineitem", LINEITEM_KINDS))
def profile_roles_lineitem(spark, sf_dir):
    return _roles(load(spark, sf_dir, "lineitem"))


@register("profile_roles_customer", role_sql("customer", CUSTOMER_KINDS))
def profile_roles_customer(spark, sf_dir):
    return _roles(load(spark, sf_dir, "customer"))


EVENTS_BLANKS_SQL = """(SELECT event_id, ts, CASE WHEN event_type = 'view' AND value > 50 THEN NULL ELSE user_id END AS user_id,
  CASE WHEN value < 1.0 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
  CASE WHEN value < 2.0 THEN NULL ELSE props END AS props FROM events)"""


def events_with_blanks(spark, sf_dir):
    """events with blanks made from data conditions (same on the SQL side)."""
    e = load(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts",
        F.when((F.col("event_type") == "view") & (F.col("value") > 50), None).otherwise(F.col("user_id")).alias("user_id"),
        F.when(F.col("value") < 1.0, None).otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_type") == "error", None).otherwise(F.col("value")).alias("value"),
        F.when(F.col("value") < 2.0, None).otherwise(F.col("props")).alias("props"),
    )


@register("profile_roles_events_blanks", role_sql("events", EVENTS_KINDS, EVENTS_BLANKS_SQL))
def profile_roles_events_blanks(spark, sf_dir):
    return _roles(events_with_blanks(spark, sf_dir))


def _numeric_sql(table: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        parts.append(f"""SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS n, min({c}) AS min, max({c}) AS max,
  round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median,
  round(coalesce(stddev_samp({c}), 0.0), 6) AS std, round(sum({c}), 2) AS sum,
  CAST(count_if({c} = 0) AS BIGINT) AS zeros, CAST(count_if({c} < 0) AS BIGINT) AS negatives,
  round(CASE WHEN count({c}) > 2 THEN CASE WHEN coalesce(stddev_samp({c}), 0) = 0 THEN 0.0 ELSE skewness({c}) END END, 6) AS skew
FROM {table}""")
    return "\nUNION ALL\n".join(parts)


NUMERIC_LINEITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("profile_numeric_lineitem", _numeric_sql("lineitem", NUMERIC_LINEITEM))
def profile_numeric_lineitem(spark, sf_dir):
    s = P.numeric_stats(load(spark, sf_dir, "lineitem"), NUMERIC_LINEITEM)
    return s.select("column_name", "n", "min", "max", F.round("mean", 6).alias("mean"),
                    F.round("median", 6).alias("median"), F.round("std", 6).alias("std"),
                    F.round("sum", 2).alias("sum"), "zeros", "negatives", F.round("skew", 6).alias("skew"))


@register("profile_numeric_customer", _numeric_sql("customer", ["c_acctbal"]))
def profile_numeric_customer(spark, sf_dir):
    s = P.numeric_stats(load(spark, sf_dir, "customer"), ["c_acctbal"])
    return s.select("column_name", "n", "min", "max", F.round("mean", 6).alias("mean"),
                    F.round("median", 6).alias("median"), F.round("std", 6).alias("std"),
                    F.round("sum", 2).alias("sum"), "zeros", "negatives", F.round("skew", 6).alias("skew"))


CATEGORY_LINEITEM = ["l_returnflag", "l_linestatus", "l_linenumber"]


@register("profile_category_lineitem", f"""
WITH h AS ({histogram_sql("lineitem", CATEGORY_LINEITEM)}),
r AS (SELECT column_name, value, cnt,
             row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value ASC) AS rank,
             sum(cnt) OVER (PARTITION BY column_name) AS nn,
             count(*) OVER (PARTITION BY column_name) AS dc,
             max(cnt) OVER (PARTITION BY column_name) AS top_cnt
      FROM h WHERE value IS NOT NULL)
SELECT column_name, CAST(rank AS INTEGER) AS rank, value, CAST(cnt AS BIGINT) AS cnt,
       CAST(dc AS BIGINT) AS distinct_count, round(CAST(top_cnt AS DOUBLE) / nn, 4) AS top_share
FROM r WHERE rank <= 8
""")
def profile_category_lineitem(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return P.category_stats(P.histogram(li, CATEGORY_LINEITEM))


@register("profile_category_orders", f"""
WITH h AS ({histogram_sql("orders", ["o_orderpriority", "o_orderstatus", "o_custkey"])}),
r AS (SELECT column_name, value, cnt,
             row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value ASC) AS rank,
             sum(cnt) OVER (PARTITION BY column_name) AS nn,
             count(*) OVER (PARTITION BY column_name) AS dc,
             max(cnt) OVER (PARTITION BY column_name) AS top_cnt
      FROM h WHERE value IS NOT NULL)
SELECT column_name, CAST(rank AS INTEGER) AS rank, value, CAST(cnt AS BIGINT) AS cnt,
       CAST(dc AS BIGINT) AS distinct_count, round(CAST(top_cnt AS DOUBLE) / nn, 4) AS top_share
FROM r WHERE rank <= 8
""")
def profile_category_orders(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return P.category_stats(P.histogram(o, ["o_orderpriority", "o_orderstatus", "o_custkey"]))


@register("profile_datetime", """
SELECT 'ts' AS column_name, strftime(min(ts), '%Y-%m-%d') AS earliest, strftime(max(ts), '%Y-%m-%d') AS latest,
       CAST(floor(epoch_us(max(ts) - min(ts)) / 86400000000.0) AS BIGINT) AS span_days FROM events
UNION ALL
SELECT 'o_orderdate', strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d'),
       CAST(floor(epoch_us(max(o_orderdate) - min(o_orderdate)) / 86400000000.0) AS BIGINT) FROM orders
""")
def profile_datetime(spark, sf_dir):
    e = P.datetime_stats(load(spark, sf_dir, "events"), ["ts"])
    o = P.datetime_stats(load(spark, sf_dir, "orders"), ["o_orderdate"])
    return e.unionByName(o)


@register("profile_completeness", f"""
WITH b AS {EVENTS_BLANKS_SQL},
s AS (SELECT 'event_id' AS column_name, avg(CASE WHEN event_id IS NULL THEN 1.0 ELSE 0.0 END) AS share FROM b
  UNION ALL SELECT 'ts', avg(CASE WHEN ts IS NULL THEN 1.0 ELSE 0.0 END) FROM b
  UNION ALL SELECT 'user_id', avg(CASE WHEN user_id IS NULL THEN 1.0 ELSE 0.0 END) FROM b
  UNION ALL SELECT 'event_type', avg(CASE WHEN event_type IS NULL THEN 1.0 ELSE 0.0 END) FROM b
  UNION ALL SELECT 'value', avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) FROM b
  UNION ALL SELECT 'props', avg(CASE WHEN props IS NULL THEN 1.0 ELSE 0.0 END) FROM b)
SELECT column_name, round(share * 100, 1) AS pct_empty FROM s WHERE share > 0
ORDER BY share DESC, column_name LIMIT 8
""")
def profile_completeness(spark, sf_dir):
    return P.completeness(events_with_blanks(spark, sf_dir))


@register("profile_dataset_lineitem", """
SELECT CAST(11 AS BIGINT) AS column_count,
       CAST((SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT) AS duplicate_rows,
       CAST((SELECT count(*) FROM lineitem) AS BIGINT) AS row_count
""")
def profile_dataset_lineitem(spark, sf_dir):
    return P.dataset_summary(load(spark, sf_dir, "lineitem"))


@register("profile_notes_events", f"""
WITH b AS {EVENTS_BLANKS_SQL},
m AS (SELECT 'value' AS column_name, 'measure' AS role,
             avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS rate,
             count_if(value < 0) AS neg,
             CASE WHEN count(value) > 2 THEN skewness(value) END AS skew FROM b
      UNION ALL
      SELECT 'user_id', 'measure', avg(CASE WHEN user_id IS NULL THEN 1.0 ELSE 0.0 END),
             count_if(user_id < 0), CASE WHEN count(user_id) > 2 THEN skewness(user_id) END FROM b)
SELECT column_name,
  array_to_string(list_filter([
     CASE WHEN rate >= 0.5 THEN 'mostly_empty' WHEN rate >= 0.1 THEN 'partly_empty' END,
     CASE WHEN neg > 0 THEN 'negatives' END,
     CASE WHEN abs(coalesce(skew, 0)) > 2 THEN 'skewed' END], lambda x: x IS NOT NULL), '; ') AS notes
FROM m
""")
def profile_notes_events(spark, sf_dir):
    df = events_with_blanks(spark, sf_dir).select("value", "user_id")
    prof = P.profile_dataset(df, {"value": "measure", "user_id": "measure"})
    stats = P.numeric_stats(df, ["value", "user_id"])
    return P.column_notes(prof, stats)


def _grown_lineitem(spark, sf_dir):
    """The whole of lineitem, written in two steps with a refresh of the profile's state after each."""
    top = f"{ensure_checkpoint_dir(spark)}/tables/lineitem-{uuid.uuid4().hex[:12]}"
    state = ProfileState(spark, f"{top}.parquet", f"{top}-state")
    li = load(spark, sf_dir, "lineitem")
    for late in (False, True):
        li.where((F.year("l_shipdate") >= 1996) == late).write.mode("append").parquet(f"{top}.parquet")
        state.refresh()
    return state


@register("profile_incremental_roles", role_sql("lineitem", LINEITEM_KINDS))
def profile_incremental_roles(spark, sf_dir):
    return _grown_lineitem(spark, sf_dir).profile().select("column_name", "role", "missing_count", "missing_rate", "unique_count")


@register("profile_incremental_moments", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count({c})::BIGINT AS n, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}::DOUBLE), 8) AS mean,
  round(stddev_samp({c}::DOUBLE), 6) AS std, count(*) FILTER (WHERE {c} = 0)::BIGINT AS zeros, count(*) FILTER (WHERE {c} < 0)::BIGINT AS negatives,
  round(skewness({c}::DOUBLE), 6) AS skew FROM lineitem""" for c in NUMERIC_LINEITEM))
def profile_incremental_moments(spark, sf_dir):
    s = _grown_lineitem(spark, sf_dir).numeric_stats().where(F.col("column_name").isin(*NUMERIC_LINEITEM))
    return s.select("column_name", "n", "min", "max", F.round("mean", 8).alias("mean"), F.round("std", 6).alias("std"), "zeros", "negatives",
                    F.round("skew", 6).alias("skew"))
