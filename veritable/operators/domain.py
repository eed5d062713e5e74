"""Domain inference, measure additivity and run quality.

Domain scoring is a catalogue job: for every token of the column catalogue
(one row per column of every table, plus the table name as a source token)
the fixed (family, signal) list - a constant array of about 160 entries - is
filtered to the signals the token contains and exploded; signals matched per
(table, family) are counted, and the best family per table is a top-1. No
join against the signal list: the work is linear in the catalogue.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Domain families and their signal tokens, in ranking order.
FAMILY_SIGNALS = (
    ("earth_science", ("earthquake", "seismic", "quake", "magnitude", "magtype", "depth", "epicenter",
                       "horizontalerror", "deptherror", "magnst")),
    ("weather", ("temperature", "humidity", "rainfall", "precipitation", "windspeed", "weather", "station",
                 "airquality", "pm25", "pm10")),
    ("health", ("patient", "diagnosis", "treatment", "clinical", "bloodpressure", "heartrate", "symptom",
                "disease", "hospital")),
    ("education", ("student", "grade", "score", "course", "attendance", "school", "teacher", "exam")),
    ("technology", ("device", "sensor", "latency", "cpu", "memoryusage", "errorcode", "loglevel", "requestid",
                    "uptime")),
    ("sports", ("player", "team", "match", "score", "goals", "assists", "minutesplayed", "opponent", "season",
                "tournament")),
    ("transport", ("trip", "vehicle", "route", "origin", "destination", "speed", "distance", "traffic", "arrival",
                   "departure")),
    ("public_safety", ("incident", "crime", "offense", "casetype", "victim", "suspect", "severity", "police",
                       "emergency")),
    ("agriculture", ("crop", "yield", "harvest", "soil", "fertilizer", "irrigation", "farm", "rainfall",
                     "pesticide")),
    ("energy", ("energy", "power", "electricity", "voltage", "current", "kilowatt", "kwh", "generation",
                "consumption", "meter")),
    ("manufacturing", ("machine", "batch", "defect", "production", "downtime", "cycle_time", "quality", "plant",
                       "workorder")),
    ("laboratory", ("sample", "experiment", "assay", "concentration", "control", "treatment", "replicate",
                    "specimen", "measurement")),
    ("population", ("population", "household", "demographic", "census", "birth", "death", "migration",
                    "occupation", "maritalstatus")),
    ("media", ("post", "content", "author", "sentiment", "engagement", "likes", "comments", "shares",
               "impressions", "hashtag")),
    ("markets", ("ticker", "symbol", "open", "close", "high", "low", "volume", "marketcap", "return",
                 "volatility")),
    ("ecology", ("species", "habitat", "biodiversity", "abundance", "ecosystem", "survey", "vegetation",
                 "wildlife", "genus")),
    ("business", ("revenue", "sales", "sale", "orderid", "invoice", "customerid", "product", "profit", "price",
                  "quantity", "expense")),
)
# What one row is, by keyword group.
SUBJECT_SIGNALS = (
    (("order", "invoice", "sale", "transaction", "revenue"), "sales transactions"),
    (("product", "sku", "stock", "inventory", "warehouse"), "inventory or stock"),
    (("payment", "ledger", "expense", "debit", "credit"), "financial entries"),
    (("ticket", "delivery", "shipment", "visit", "job"), "operational events"),
    (("customer", "client", "member", "account"), "customer records"),
)
ADDITIVE_WORDS = ("revenue", "sales", "amount", "profit", "cost", "expense", "quantity", "units")
KNOWN_SCORE, HIGH_SCORE = 2, 4
QUALITY_WEIGHTS = {"completion": 0.20, "grounded": 0.20, "evidence": 0.15, "action": 0.10, "chart_link": 0.10,
                   "domain": 0.15, "semantic": 0.10, "error_rate": -0.25}


def norm_expr(c):
    """Lower-case and keep only letters, digits and Arabic letters."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9\\x{0600}-\\x{06ff}]+", "")


def _norm_text(s: str) -> str:
    """``norm_expr`` for a Python string (the fixed tokens below)."""
    return re.sub("[^a-z0-9\u0600-\u06ff]+", "", s.lower())


# The fixed lists as SQL array literals: one parsed expression each, instead
# of one JVM call per entry when the plan is built.
FAMILY_SIGNALS_SQL = "array({})".format(", ".join(
    f"named_struct('family_order', {i}, 'family', '{fam}', 'signal', '{tok}', 'nsig', '{_norm_text(tok)}')"
    for i, (fam, toks) in enumerate(FAMILY_SIGNALS) for tok in toks))
FAMILIES_SQL = "array({})".format(", ".join(
    f"named_struct('family_order', {i}, 'family', '{fam}')" for i, (fam, _toks) in enumerate(FAMILY_SIGNALS)))


def signals_found(text: Column) -> Column:
    """(family_order, family, signal, nsig) of every fixed signal found in
    ``text`` (already normalised): a filter over a constant array, so a
    linear scan with no join against the signal list."""
    return F.filter(F.expr(FAMILY_SIGNALS_SQL), lambda s: text.contains(s["nsig"]))


def domain_scores(catalog: DataFrame) -> DataFrame:
    """(table_name, family, score, matched) for every family, one job.

    ``catalog`` has (table_name, column_name); the table name itself is a
    source token, as a file name would be.
    """
    names = catalog.select("table_name", norm_expr(F.col("column_name")).alias("token"))
    sources = catalog.select("table_name").distinct().select("table_name", norm_expr(F.col("table_name")).alias("token"))
    hay = names.unionByName(sources)
    # every signal of the fixed list found in a token, as an exploded array of
    # literals (no join against the signal list)
    hits = (hay.select("table_name", F.explode(signals_found(F.col("token"))).alias("_h"))
            .select("table_name", "_h.family", "_h.signal").distinct())
    # every table against every family of the fixed list (one row per family)
    grid = (catalog.select("table_name").distinct().select("table_name", F.explode(F.expr(FAMILIES_SQL)).alias("_f"))
            .select("table_name", "_f.*"))
    counts = hits.groupBy("table_name", "family").agg(F.count(F.lit(1)).alias("score"),
                                                      F.array_sort(F.collect_list("signal")).alias("matched"))
    return grid.join(counts, ["table_name", "family"], "left").select(
        "table_name", "family", "family_order", F.coalesce("score", F.lit(0)).cast("bigint").alias("score"),
        F.coalesce("matched", F.array().cast("array<string>")).alias("matched"))


def infer_family(scores: DataFrame) -> DataFrame:
    """Best family per table (first in family order on ties); known at >= 2
    signals, high confidence at >= 4; otherwise ``general``."""
    best = scores.groupBy("table_name").agg(F.min_by(F.struct("family", "score", "matched"),
                                                     F.struct(-F.col("score"), F.col("family_order"))).alias("b"))
    known = F.col("b.score") >= KNOWN_SCORE
    business_sales = F.arrays_overlap(F.col("b.matched"), F.array(*[F.lit(x) for x in ("revenue", "sales", "sale", "orderid", "invoice")]))
    return best.select(
        "table_name", F.when(known, F.col("b.family")).otherwise("general").alias("family"),
        F.col("b.score").alias("score"),
        F.when(~known, "low").when(F.col("b.score") >= HIGH_SCORE, "high").otherwise("medium").alias("confidence"),
        (known & (F.col("b.family") == "business") & business_sales).alias("sales_transactions"),
    )


def measure_aggregation(catalog: DataFrame, families: DataFrame, roles: DataFrame) -> DataFrame:
    """``sum`` only for business tables and additive measure names, else ``mean``.
    ``roles``: (table_name, column_name, role)."""
    m = roles.filter(F.col("role") == "measure").join(families.select("table_name", "family"), "table_name")
    n = norm_expr(F.col("column_name"))
    additive = F.lit(False)
    for w in ADDITIVE_WORDS:
        additive = additive | n.contains(w)
    return m.select("table_name", "column_name",
                    F.when((F.col("family") == "business") & additive, "sum").otherwise("mean").alias("aggregation"))


def lead_facts(df: DataFrame, measure: str, place: str | None = None) -> DataFrame:
    """Max and median of the primary measure and the place of the largest (of equal ones the first by place)."""
    from veritable.functions.exprs import num
    from veritable.functions.quantiles import quantile_literal

    x = num(measure)
    aggs = [F.max(x).alias("largest"), quantile_literal(df, measure, 0.5).alias("median")]
    if place:
        aggs.append(F.min_by(F.col(place), F.when(x.isNotNull(), F.struct(-x, F.col(place)))).alias("largest_place"))
    return df.agg(*aggs)


def row_subject(catalog: DataFrame) -> DataFrame:
    """Which keyword group the column names point to (high at >= 2 hits)."""
    names = catalog.groupBy("table_name").agg(F.concat_ws(" ", F.collect_list(F.lower("column_name"))).alias("_names"))
    # one entry per keyword found in the table's names (fixed keyword list as expressions)
    keywords = F.expr("array({})".format(", ".join(
        f"named_struct('subject_order', {i}, 'subject', '{subj}', 'keyword', '{kw}')"
        for i, (kws, subj) in enumerate(SUBJECT_SIGNALS) for kw in kws)))
    found = F.filter(keywords, lambda k: F.col("_names").contains(k["keyword"]))
    grid = names.select("table_name", F.explode(found).alias("_h")).select("table_name", "_h.subject_order", "_h.subject")
    cnt = grid.groupBy("table_name", "subject_order", "subject").agg(F.count(F.lit(1)).alias("hits"))
    best = cnt.groupBy("table_name").agg(F.min_by(F.struct("subject", "hits"), F.struct(-F.col("hits"), F.col("subject_order"))).alias("b"))
    out = names.select("table_name").join(best, "table_name", "left")
    return out.select("table_name", F.coalesce(F.col("b.subject"), F.lit("one business record")).alias("subject"),
                      F.when(F.col("b.hits") >= 2, "high").when(F.col("b.hits") >= 1, "medium").otherwise("low").alias("confidence"))


def family_from_text(texts: DataFrame, text_col: str) -> DataFrame:
    """Family signals counted in free-text descriptions (best, else general; of equal ones the last by name)."""
    t = texts.select("*", norm_expr(F.col(text_col)).alias("_n"))
    hits = (t.select("description_id", F.explode(signals_found(F.col("_n"))).alias("_h"))
            .select("description_id", "_h.family_order", "_h.family"))
    cnt = hits.groupBy("description_id", "family_order", "family").agg(F.count(F.lit(1)).alias("score"))
    best = cnt.groupBy("description_id").agg(F.max_by(F.struct("family", "score"), F.struct(F.col("score"), F.col("family"))).alias("b"))
    return t.select("description_id").join(best, "description_id", "left").select(
        "description_id", F.coalesce(F.col("b.family"), F.lit("general")).alias("family"))


def run_quality(stages: DataFrame, findings: DataFrame, charts: DataFrame, errors: DataFrame,
                domain_understanding: float = 1.0, semantic_consistency: float = 1.0) -> DataFrame:
    """U4: weighted quality score 0..100 (1 dp) per run_id.

    stages(run_id, status); findings(run_id, grounded, evidence, action, chart_id);
    charts(run_id, chart_id); errors(run_id, message).
    """
    st = stages.groupBy("run_id").agg(F.avg(F.col("status").isin("done", "skipped").cast("double")).alias("completion"),
                                      F.count(F.lit(1)).alias("_stages"))
    fc = findings.join(charts.select("run_id", "chart_id").withColumn("_linked", F.lit(True)), ["run_id", "chart_id"], "left")
    fi = fc.groupBy("run_id").agg(
        F.avg(F.col("grounded").cast("double")).alias("grounded"),
        F.avg((F.length(F.trim("evidence")) > 0).cast("double")).alias("evidence"),
        F.avg((F.length(F.trim("action")) > 0).cast("double")).alias("action"),
        F.avg(F.coalesce("_linked", F.lit(False)).cast("double")).alias("chart_link"))
    er = errors.groupBy("run_id").agg(F.count(F.lit(1)).alias("_errors"))
    j = st.join(fi, "run_id", "left").join(er, "run_id", "left").fillna(0.0, ["grounded", "evidence", "action", "chart_link"])
    err_rate = F.coalesce(F.col("_errors"), F.lit(0)) / F.greatest(F.col("_stages"), F.lit(1))
    w = QUALITY_WEIGHTS
    score = 100 * (w["completion"] * F.col("completion") + w["grounded"] * F.col("grounded")
                   + w["evidence"] * F.col("evidence") + w["action"] * F.col("action")
                   + w["chart_link"] * F.col("chart_link") + w["domain"] * F.lit(domain_understanding)
                   + w["semantic"] * F.lit(semantic_consistency) + w["error_rate"] * err_rate)
    return j.select("run_id", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)), 1).alias("score"),
                    "completion", "grounded", "evidence", "action", "chart_link", err_rate.alias("error_rate"))
