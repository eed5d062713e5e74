"""Ledger queries (L1-L9) over events re-read as feedback and conversations
re-read as memory versions; grounding queries (N1-N8) over documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritable.operators import charts as CH
from veritable.operators import grounding as N
from veritable.operators import kpis as K
from veritable.operators import ledger as L
from veritable.queries.registry import register
from veritable.session import ensure_checkpoint_dir
from veritable.sources.tables import load

RATING_SQL = ("CASE WHEN event_type IN ('purchase', 'signup') THEN 'useful' "
              "WHEN event_type = 'error' THEN 'incorrect' ELSE 'not_useful' END")


AS_OF = "2024-01-01"


def feedback(spark, sf_dir):
    """events as feedback rows: a user's run rates item k of its props, again and again; odd users are another project's."""
    e = load(spark, sf_dir, "events")
    rating = (F.when(F.col("event_type").isin("purchase", "signup"), "useful")
              .when(F.col("event_type") == "error", "incorrect").otherwise("not_useful"))
    conf = F.when(F.col("value") > 50, "high").otherwise("low")
    return e.select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.when(F.col("user_id") % 2 == 0, "default").otherwise("second").alias("project_id"),
        F.lit("finding").alias("item_type"), F.get_json_object("props", "$.k").alias("item_key"), rating.alias("rating"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("value is "), F.col("value").cast("string"))).alias("correction"),
        F.to_json(F.create_map(F.lit("axis"), F.col("event_type"), F.lit("confidence"), conf)).alias("context"),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" "), F.lpad(F.col("event_id").cast("string"), 15, "0"))
        .alias("created_at"),
    )


FEEDBACK_SQL = f"""(SELECT 'run-' || CAST(user_id AS VARCHAR) AS run_id,
  CASE WHEN user_id % 2 = 0 THEN 'default' ELSE 'second' END AS project_id, 'finding' AS item_type,
  json_extract_string(props, '$.k') AS item_key, {RATING_SQL} AS rating,
  CASE WHEN event_type = 'error' THEN 'value is ' || CAST(value AS VARCHAR) END AS correction,
  event_type AS axis, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS confidence,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' ' || lpad(CAST(event_id AS VARCHAR), 15, '0') AS created_at FROM events)"""
LATEST_SQL = f"""(SELECT * FROM {FEEDBACK_SQL} QUALIFY row_number() OVER (PARTITION BY run_id, item_type, item_key
  ORDER BY created_at DESC) = 1)"""
MINE_SQL = f"(SELECT * FROM {LATEST_SQL} WHERE project_id = 'default')"


@register("ledger_latest_feedback", f"SELECT run_id, item_type, item_key, rating FROM {LATEST_SQL}")
def ledger_latest_feedback(spark, sf_dir):
    return L.latest_feedback(feedback(spark, sf_dir)).select("run_id", "item_type", "item_key", "rating")


@register("ledger_pending_lessons", f"""
SELECT run_id || ':' || item_type || ':' || item_key AS lesson_id, project_id, correction AS statement, 'pending' AS status
FROM {LATEST_SQL} WHERE rating = 'incorrect' AND length(trim(coalesce(correction, ''))) > 0
""")
def ledger_pending_lessons(spark, sf_dir):
    return L.pending_lessons(feedback(spark, sf_dir)).select("lesson_id", "project_id", "statement", "status")


def reviews(lessons):
    """Every third lesson approved, every third rejected, by the length of its statement."""
    turn = F.length("statement") % 3
    return lessons.where(turn < 2).select("lesson_id", F.when(turn == 0, "approve").otherwise("reject").alias("decision"))


LESSONS_SQL = f"""(SELECT run_id || ':' || item_type || ':' || item_key AS lesson_id, project_id, correction AS statement
  FROM {LATEST_SQL} WHERE rating = 'incorrect' AND length(trim(coalesce(correction, ''))) > 0)"""


@register("ledger_review_lessons", f"""
SELECT lesson_id, statement, CASE length(statement) % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status
FROM {LESSONS_SQL}
""")
def ledger_review_lessons(spark, sf_dir):
    lessons = L.pending_lessons(feedback(spark, sf_dir))
    return L.review_lessons(lessons, reviews(lessons)).select("lesson_id", "statement", "status")


@register("ledger_approved_memory", f"""
SELECT 'lesson:' || min(lesson_id) AS id, project_id, any_value(statement) AS statement, 1 AS version
FROM {LESSONS_SQL} WHERE length(statement) % 3 = 0 GROUP BY project_id, lower(trim(statement))
""")
def ledger_approved_memory(spark, sf_dir):
    """Approved lessons as memory items; equal statements of a project become one item."""
    lessons = L.pending_lessons(feedback(spark, sf_dir))
    history = memory_history(spark, sf_dir).where("false")
    return L.approve_into_memory(history, lessons, reviews(lessons), AS_OF).select("id", "project_id", "statement", "version")


PROFILE_SQL = f"""
WITH w AS (SELECT CAST(CASE rating WHEN 'useful' THEN 2.0 WHEN 'not_useful' THEN -1.0 ELSE -2.0 END AS DOUBLE) AS w, axis, confidence
           FROM {MINE_SQL})
SELECT 'axes' AS kind, lower(trim(axis)) AS value, round(sum(w), 3) AS score, CAST(count(*) AS BIGINT) AS count FROM w GROUP BY 2
UNION ALL
SELECT 'confidence', lower(trim(confidence)), round(sum(w), 3), CAST(count(*) AS BIGINT) FROM w GROUP BY 2
"""


@register("ledger_preference_profile", PROFILE_SQL)
def ledger_preference_profile(spark, sf_dir):
    return L.preference_profile(feedback(spark, sf_dir), "default")


@register("ledger_rank_axes", f"""
WITH p AS ({PROFILE_SQL}),
items AS (SELECT DISTINCT event_type AS axis, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS confidence FROM events)
SELECT axis, confidence, 0 AS default_position, coalesce(a.score, 0.0) * 2.0 + coalesce(c.score, 0.0) * 0.5 AS preference
FROM items LEFT JOIN p a ON a.kind = 'axes' AND a.value = lower(items.axis)
LEFT JOIN p c ON c.kind = 'confidence' AND c.value = items.confidence
""")
def ledger_rank_axes(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    items = e.select(F.col("event_type").alias("axis"), F.when(F.col("value") > 50, "high").otherwise("low").alias("confidence"),
                     F.lit(0).alias("default_position")).distinct()
    weights = {"axis_weight": 2.0, "confidence_weight": 0.5}
    return L.rank_items(items, L.preference_profile(feedback(spark, sf_dir), "default"),
                        {"axes": "axis", "confidence": "confidence"}, weights)


@register("ledger_policy_check", f"""
WITH p AS ({PROFILE_SQL}),
a AS (SELECT sum(greatest(score, 0) * CASE kind WHEN 'axes' THEN 2.0 ELSE 0.5 END) AS pc,
             sum(abs(least(score, 0)) * CASE kind WHEN 'axes' THEN 2.0 ELSE 0.5 END) AS nc,
             sum(greatest(score, 0)) AS pb, sum(abs(least(score, 0))) AS nb FROM p),
s AS (SELECT count(*) AS samples FROM {MINE_SQL})
SELECT round(100 * pc / greatest(1.0, pc + nc), 1) AS candidate_alignment,
       round(100 * pb / greatest(1.0, pb + nb), 1) AS baseline_alignment,
       round(round(100 * pc / greatest(1.0, pc + nc), 1) - round(100 * pb / greatest(1.0, pb + nb), 1), 1) AS alignment_delta,
       true AS guardrails_passed,
       samples = 0 OR round(100 * pc / greatest(1.0, pc + nc), 1) >= round(100 * pb / greatest(1.0, pb + nb), 1) AS quality_gate_passed,
       CAST(samples AS BIGINT) AS samples,
       CASE WHEN samples = 0 OR round(100 * pc / greatest(1.0, pc + nc), 1) >= round(100 * pb / greatest(1.0, pb + nb), 1)
            THEN 'validated' ELSE 'rejected' END AS status
FROM a, s
""")
def ledger_policy_check(spark, sf_dir):
    fb = feedback(spark, sf_dir)
    candidate = {"axis_weight": 2.0, "kpi_weight": 0.5, "chart_weight": 0.5, "confidence_weight": 0.5}
    parent = {"axis_weight": 1.0, "kpi_weight": 1.0, "chart_weight": 1.0, "confidence_weight": 1.0}
    return L.policy_check(L.preference_profile(fb, "default"), candidate, parent, L.project_ratings(fb, "default"))


def policies(spark, sf_dir):
    """One policy per nation, one project per region; the first is active, the second validated, the rest drafts."""
    n = load(spark, sf_dir, "nation")
    place = F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey"))
    return n.select(
        F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("policy_id"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("project_id"), place.alias("version"),
        F.when(place == 1, "active").when(place == 2, "validated").otherwise("draft").alias("status"),
        F.lag(F.concat(F.lit("p"), F.col("n_nationkey").cast("string"))).over(W.partitionBy("n_regionkey").orderBy("n_nationkey"))
        .alias("parent_id"))


_POLICIES_SQL = """(SELECT 'p' || n_nationkey AS policy_id, 'r' || n_regionkey AS project_id,
  CAST(row_number() OVER w AS INTEGER) AS version, 'p' || lag(n_nationkey) OVER w AS parent_id
  FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey))"""


def _second_policy(df):
    return df.where("project_id = 'r1' AND version = 2").first()["policy_id"]


@register("ledger_policy_activate", f"""
SELECT policy_id, project_id, CASE WHEN version = 1 THEN CASE WHEN project_id = 'r1' THEN 'retired' ELSE 'active' END
  WHEN version = 2 THEN CASE WHEN project_id = 'r1' THEN 'active' ELSE 'validated' END ELSE 'draft' END AS status
FROM {_POLICIES_SQL}
""")
def ledger_policy_activate(spark, sf_dir):
    df = policies(spark, sf_dir)
    return L.activate(df, _second_policy(df)).select("policy_id", "project_id", "status")


@register("ledger_policy_roll_back", f"""
SELECT policy_id, project_id, CASE WHEN version = 1 THEN 'active'
  WHEN version = 2 THEN CASE WHEN project_id = 'r1' THEN 'retired' ELSE 'validated' END ELSE 'draft' END AS status
FROM {_POLICIES_SQL}
""")
def ledger_policy_roll_back(spark, sf_dir):
    df = policies(spark, sf_dir)
    return L.roll_back(L.activate(df, _second_policy(df)), "r1").select("policy_id", "project_id", "status")


def memory_history(spark, sf_dir):
    """conversations as memory versions: one item per conversation, two turns a version number (so that versions tie);
    user turns are active, every third conversation is bound to a data set, every fourth to another project."""
    c = load(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("m"), F.col("conv_id").cast("string")).alias("id"),
        F.when(F.col("conv_id") % 4 == 0, "second").otherwise("default").alias("project_id"),
        F.col("text").alias("statement"), F.lit("context").alias("category"),
        F.when((F.col("role") == "user") | (F.col("turn") > 0), "active").otherwise("archived").alias("status"),
        F.when(F.col("conv_id") % 3 == 0, "dataset").otherwise("project").alias("scope"),
        F.array(F.when(F.col("conv_id") % 2 == 0, "Turn").otherwise("other")).alias("columns"),
        (F.floor(F.col("turn") / 2) + 1).cast("int").alias("version"),
        F.when(F.length("text") > 150, F.when(F.col("conv_id") % 5 == 0, "2030-01-01").otherwise("2000-01-01")).alias("valid_to"),
        F.lpad(F.col("turn").cast("string"), 6, "0").alias("updated_at"),
    )


HISTORY_SQL = """(SELECT 'm' || CAST(conv_id AS VARCHAR) AS id, CASE WHEN conv_id % 4 = 0 THEN 'second' ELSE 'default' END AS project_id,
  text AS statement, CASE WHEN role = 'user' OR turn > 0 THEN 'active' ELSE 'archived' END AS status,
  CASE WHEN conv_id % 3 = 0 THEN 'dataset' ELSE 'project' END AS scope, conv_id % 2 = 0 AS shares_column,
  CAST(turn // 2 + 1 AS INTEGER) AS version, lpad(CAST(turn AS VARCHAR), 6, '0') AS updated_at,
  CASE WHEN length(text) > 150 THEN CASE WHEN conv_id % 5 = 0 THEN '2030-01-01' ELSE '2000-01-01' END END AS valid_to
  FROM conversations)"""
MEMORY_SQL = f"""(SELECT * FROM {HISTORY_SQL} QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, updated_at DESC) = 1)"""
IN_FORCE_SQL = f"(SELECT * FROM {MEMORY_SQL} WHERE status = 'active' AND NOT coalesce(valid_to < '{AS_OF}', false))"


@register("ledger_active_memory", f"""
SELECT id, version, scope FROM {IN_FORCE_SQL} WHERE project_id = 'default' AND (scope <> 'dataset' OR shares_column)
""")
def ledger_active_memory(spark, sf_dir):
    found = L.active_memory(memory_history(spark, sf_dir), "default", ["conv_id", "turn", "role"], AS_OF)
    return found.select("id", "version", "scope")


@register("ledger_expire", f"""
SELECT id, 'expired' AS status, version + 1 AS version FROM {MEMORY_SQL}
WHERE status = 'active' AND valid_to IS NOT NULL AND valid_to < '{AS_OF}'
""")
def ledger_expire(spark, sf_dir):
    return L.expire(memory_history(spark, sf_dir), AS_OF).select("id", "status", "version")


@register("ledger_restore", f"""
SELECT h.id, h.statement, m.version + 1 AS version FROM
  (SELECT * FROM {HISTORY_SQL} WHERE version = 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at) = 1) h
  JOIN {MEMORY_SQL} m ON m.id = h.id
""")
def ledger_restore(spark, sf_dir):
    """The first turn of every conversation restored as a new version."""
    history = memory_history(spark, sf_dir).where("version > 1 OR updated_at = '000000'")
    whole = L.latest_versions(memory_history(spark, sf_dir)).select("id", F.col("version").alias("newest"))
    after = L.latest_versions(L.restore(history, history.where("version = 1").select("id", "version"), AS_OF))
    return after.join(whole, "id").select("id", "statement", (F.col("newest") + 1).alias("version"))


@register("ledger_snapshot_memory", f"""
SELECT id, project_id, statement, status, version FROM {MEMORY_SQL}
""")
def ledger_snapshot_memory(spark, sf_dir):
    """The memory appended turn class by turn class, compacted in between: snapshot and later rows give the state."""
    history = memory_history(spark, sf_dir)
    store = L.MemoryStore(spark, f"{ensure_checkpoint_dir(spark)}/tables/memory-{uuid.uuid4().hex[:12]}")
    store.append(history.where("version = 2"))
    store.append(history.where("version > 2"))
    store.compact()
    store.append(history.where("version < 2"))
    return store.current().select("id", "project_id", "statement", "status", "version")


@register("ledger_counters", f"""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM {IN_FORCE_SQL} WHERE project_id = 'default') AS active_memory,
       (SELECT CAST(count(*) AS BIGINT) FROM {MINE_SQL} WHERE rating = 'incorrect'
          AND length(trim(coalesce(correction, ''))) > 0) AS pending_lessons,
       (SELECT CAST(count(*) AS BIGINT) FROM {MINE_SQL} WHERE rating = 'incorrect') AS corrections,
       (SELECT CAST(count(*) AS BIGINT) FROM {MINE_SQL} WHERE rating = 'useful') AS useful
""")
def ledger_counters(spark, sf_dir):
    fb = feedback(spark, sf_dir)
    return L.counters(memory_history(spark, sf_dir), L.pending_lessons(fb), fb, "default", AS_OF)


# --- grounding ------------------------------------------------------------------

def fact_base(spark, sf_dir):
    """Facts from result tables computed on the driver tables: orders KPIs,
    the priority evidence counts and the monthly trend of lineitem."""
    o = load(spark, sf_dir, "orders")
    kpis = K.scalar_kpis(o, K.KpiColumns(revenue="o_totalprice", entity="o_custkey"))
    ev = CH.evidence_counts(o, "o_orderpriority")
    tr = CH.trend(load(spark, sf_dir, "lineitem"), "l_shipdate", "l_extendedprice")
    return (N.fact_rows(kpis.select("value"), False)
            .unionByName(N.frame_facts(ev)).unionByName(N.frame_facts(tr))
            .unionByName(N.derived_share_facts(ev.select(F.lit(1).alias("g"), F.col("records").cast("double").alias("value")), ["g"])))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: Figures of documents, from the pattern and the rules for numerals (no look-around, so DuckDB reads it too).
_FIGURES_SQL = f"""
t AS (SELECT doc_id, list_filter(regexp_extract_all(text, {_sql(N.TOKENS)}), lambda x: regexp_matches(x, '^[-+]?[0-9]')) AS ts FROM documents),
n AS (SELECT doc_id, unnest(ts) AS token, unnest(range(len(ts))) AS spot FROM t),
p AS (SELECT doc_id, spot, {", ".join(f"regexp_extract(token, {_sql(N.NUMERAL)}, {k}) AS {g}" for k, g in enumerate(("sign", "run", "gap", "word", "pc"), 1))} FROM n),
q AS (SELECT *, regexp_replace(run, '[.,]+$', '') AS bare, lower(word) IN ({", ".join(_sql(u) for u in N.SUFFIXES)}) AS unit FROM p),
r AS (SELECT *, regexp_matches(bare, '^[0-9]{{1,3}}(,[0-9]{{3}})+([.][0-9]+)?$') AS grouped FROM q),
s AS (SELECT *, CASE WHEN grouped THEN [bare] ELSE string_split(bare, ',') END AS ps FROM r),
e AS (SELECT *, unnest(ps) AS piece, unnest(range(len(ps))) AS k FROM s),
figures AS (
  SELECT doc_id, spot * 1048576 + k AS ordinal, replace(piece, ',', '')::DOUBLE
      * CASE WHEN k = len(ps) - 1 AND unit THEN CASE lower(word) {" ".join(f"WHEN {_sql(u)} THEN {m}" for u, m in N.SUFFIXES.items())} END ELSE 1 END
      * CASE WHEN k = 0 AND sign = '-' THEN -1 ELSE 1 END AS value,
    k = len(ps) - 1 AND pc <> '' AND (word = '' OR unit) AS is_percentage
  FROM e WHERE (grouped OR regexp_matches(piece, '^[0-9]+([.][0-9]+)?$'))
    AND NOT (k = len(ps) - 1 AND word <> '' AND NOT unit AND gap = '' AND run = bare))"""


@register("ground_extract_documents", f"""
WITH {_FIGURES_SQL}
SELECT doc_id, ordinal::BIGINT AS ordinal, value, is_percentage FROM figures
""")
def ground_extract_documents(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    return N.extract_figures(d, "text", ["doc_id"]).select("doc_id", "ordinal", "value", "is_percentage")


@register("ground_match_prices", f"""
WITH {_FIGURES_SQL},
facts AS (SELECT o_totalprice::DOUBLE AS f FROM orders UNION SELECT l_quantity::DOUBLE FROM lineitem),
d AS (SELECT DISTINCT value, is_percentage AS pct FROM figures),
m AS (SELECT value, pct, CASE WHEN pct THEN value / 100 ELSE value END AS probe FROM d),
h AS (SELECT DISTINCT m.value, m.pct FROM m JOIN facts ON abs(probe - f) <= CASE WHEN abs(probe) <= 20 THEN 0.5 ELSE abs(probe) * 0.02 END)
SELECT doc_id, ordinal::BIGINT AS ordinal, figures.value, is_percentage,
  h.value IS NOT NULL OR (NOT is_percentage AND figures.value = floor(figures.value)
    AND (figures.value BETWEEN 0 AND 12 OR figures.value BETWEEN 1990 AND 2100)) AS held
FROM figures LEFT JOIN h ON h.value = figures.value AND h.pct = figures.is_percentage
""")
def ground_match_prices(spark, sf_dir):
    """N3 with as many facts as there are orders and line items."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    facts = load(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("double").alias("value")).unionByName(
        load(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("value"))).withColumn("is_percentage", F.lit(False))
    figs = N.extract_figures(d, "text", ["doc_id"]).drop("figure")
    return N.match_figures(figs, facts, ["doc_id"])


@register("ground_figures")
def ground_figures(spark, sf_dir):
    # The fact base is made of chart and KPI tables with display roundings:
    # rows-only; extraction and matching have SQL of their own above.
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    figs = N.extract_figures(d, "text", ["doc_id"])
    return N.match_figures(figs, fact_base(spark, sf_dir), ["doc_id"])


@register("ground_check_documents")
def ground_check_documents(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    return N.check_texts(d, "text", ["doc_id"], fact_base(spark, sf_dir))


@register("ground_strip_conversations")
def ground_strip_conversations(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").filter(F.col("role") == "assistant").select("conv_id", "turn", "text")
    return N.strip_unverified(c, "text", ["conv_id", "turn"], fact_base(spark, sf_dir))
