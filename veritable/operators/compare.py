"""Cross-run comparison, run store and schema fingerprints.

Runs are rows of append-only parquet tables in a shared folder (``runs``,
``run_kpis``); "the latest earlier run with the same fingerprint" is a
filtered top-1, not a directory walk. Comparing two runs is a join of their
KPI rows on the KPI name.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritable.functions.dates import time_column
from veritable.functions.exprs import with_scalars

# Fixed values of the comparison rules.
MATERIAL_CHANGE = 0.05
HIGH_CHANGE = 0.15
LENGTH_TOLERANCE = 0.25
DAYS_PER_MONTH = 30.44
TOTAL_WORDS = ("total", "number of", "units", "count", "customers")

# Display names of the KPI ids (the words decide what is a "total").
KPI_NAMES = {
    "total_revenue": "Total revenue", "total_profit": "Total profit", "profit_margin": "Profit margin",
    "average_order_value": "Average order value", "record_count": "Number of records",
    "active_customers": "Active customers", "repeat_rate": "Repeat customer rate", "growth_rate": "Growth rate",
    "strongest_month": "Strongest month", "units_sold": "Units sold", "top_10pct_share": "Top 10% customer share",
}
LABEL_KPIS = ("strongest_month",)


def fingerprint(columns: list[str]) -> str:
    """First 16 hex of SHA-256 over sorted, stripped, case-folded names."""
    names = sorted(str(c).strip().casefold() for c in columns)
    return hashlib.sha256("|".join(names).encode("utf-8")).hexdigest()[:16]


def fingerprint_expr(name_col: Column) -> Column:
    """S8 as an aggregate over a column catalogue (one row per column)."""
    joined = F.array_join(F.array_sort(F.collect_list(F.lower(F.trim(name_col)))), "|")
    return F.substring(F.sha2(joined, 256), 1, 16)


def filled_columns(df: DataFrame, table_name: str) -> DataFrame:
    """(table_name, column_name) of the columns that hold at least one value (S4 drops the others before a table is known)."""
    names = df.columns
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n")) for i, c in enumerate(names)])
    found = counts.select(F.explode(rows).alias("s")).where("s.n > 0")
    return found.select(F.lit(table_name).alias("table_name"), "s.column_name")


def column_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, position, dtype) from table schemas (metadata)."""
    rows = [(t, f.name, i, f.dataType.simpleString()) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int, dtype string")


def period_of(df: DataFrame, date: str) -> DataFrame:
    """V1: start, end and length in months (2 dp) of the date column."""
    ts = time_column(df, date)
    g = df.agg(F.min(ts).cast("timestamp").alias("_lo"), F.max(ts).cast("timestamp").alias("_hi"))
    days = F.floor((F.unix_micros("_hi") - F.unix_micros("_lo")) / F.lit(86400 * 1_000_000))
    return g.select(F.date_format("_lo", "yyyy-MM-dd").alias("start"), F.date_format("_hi", "yyyy-MM-dd").alias("end"),
                    F.round(F.greatest(days, F.lit(1)) / DAYS_PER_MONTH, 2).alias("months"))


def _is_total(kpi_id: Column, unit: Column) -> Column:
    name = F.lower(F.coalesce(kpi_id, F.lit("")))
    hit = F.lit(False)
    for word in TOTAL_WORDS:
        hit = hit | name.contains(word)
    return (unit != "%") & hit


def kpi_names(kpis: DataFrame) -> DataFrame:
    mapping = F.create_map(*[x for k, v in KPI_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return kpis.withColumn("name", F.coalesce(mapping[F.col("kpi_id")], F.col("kpi_id")))


def compare_runs(now: DataFrame, before: DataFrame, now_period: DataFrame, before_period: DataFrame) -> DataFrame:
    """KPI changes between two runs.

    ``now``/``before``: (kpi_id, value, unit); periods: one row with months.
    Totals are rebased per month when the two periods differ in length by more
    than 25%; % KPIs are never rebased and label KPIs are not compared.
    """
    n = kpi_names(now.filter(~F.col("kpi_id").isin(*LABEL_KPIS) & F.col("value").isNotNull()))
    b = before.filter(F.col("value").isNotNull()).select(F.col("kpi_id"), F.col("value").alias("_before"))
    comparable = (F.col("_mn").isNull() | F.col("_mb").isNull() | (F.coalesce(F.col("_mb"), F.lit(0.0)) == 0)
                  | (F.abs(F.col("_mn") - F.col("_mb")) / F.col("_mb") <= LENGTH_TOLERANCE))
    j = with_scalars(with_scalars(n.join(b, "kpi_id"), now_period.select(F.col("months").alias("_mn"))),
                     before_period.select(F.col("months").alias("_mb")))
    rebase = ~comparable & _is_total(F.col("name"), F.col("unit")) & (F.col("_mn") > 0) & (F.col("_mb") > 0)
    now_v = F.when(rebase, F.col("value") / F.col("_mn")).otherwise(F.col("value"))
    before_v = F.when(rebase, F.col("_before") / F.col("_mb")).otherwise(F.col("_before"))
    out = j.select("kpi_id", "name", "unit", now_v.alias("now"), before_v.alias("before"), rebase.alias("per_period"),
                   comparable.alias("comparable_periods"))
    diff = F.col("now") - F.col("before")
    rel = F.when(F.col("before") != 0, diff / F.abs("before")).otherwise(0.0)
    return out.select("*", diff.alias("difference"), rel.alias("relative"),
                      (F.abs(rel) >= MATERIAL_CHANGE).alias("material"),
                      F.when(diff > 0, "up").otherwise("down").alias("direction"))


def change_findings(changes: DataFrame) -> DataFrame:
    """V4: material changes as findings, high confidence from 15%."""
    return changes.filter("material").select(
        F.concat(F.col("name"), F.lit(" has "), F.when(F.col("difference") > 0, "risen").otherwise("fallen"),
                 F.lit(" since the previous run")).alias("title"),
        "kpi_id", "now", "before", "relative",
        F.when(F.abs("relative") >= HIGH_CHANGE, "high").otherwise("medium").alias("confidence"),
        F.lit("general").alias("axis"),
    )


class RunStore:
    """Run summaries and KPIs under a shared folder, a folder for each schema fingerprint.

    A run's KPIs are staged in a folder of their own; the run counts once its
    row stands in the manifest (``runs``), which is written last, in one file.
    A writer that dies in between leaves KPIs that no reader sees. A run id
    written again replaces the earlier one.
    """

    MANIFEST = "run_id string, started_at string, months double, n_kpis long, commit string, committed timestamp"

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def append(self, run_id: str, started_at: str, fp: str, months: float | None, kpis: DataFrame) -> None:
        self.commit(run_id, started_at, fp, months, self.stage(run_id, fp, kpis))

    def stage(self, run_id: str, fp: str, kpis: DataFrame) -> str:
        """Write a run's KPIs where no reader looks yet; the name of the commit."""
        commit = uuid.uuid4().hex
        rows = kpis.select(F.lit(run_id).alias("run_id"), "kpi_id", F.col("value").cast("double").alias("value"), "unit")
        rows.coalesce(1).write.parquet(self._staged(fp, commit))
        return commit

    def commit(self, run_id: str, started_at: str, fp: str, months: float | None, commit: str) -> None:
        n = self.spark.read.parquet(self._staged(fp, commit)).where("value IS NOT NULL").count()
        row = self.spark.createDataFrame([(run_id, started_at, months, n, commit)],
                                         "run_id string, started_at string, months double, n_kpis long, commit string")
        row.withColumn("committed", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/runs/fingerprint={_folder(fp)}")

    def _staged(self, fp: str, commit: str) -> str:
        return f"{self.root}/run_kpis/fingerprint={_folder(fp)}/commit={commit}"

    def _committed(self) -> DataFrame:
        """The manifest, without runs that were written again."""
        rows = self.spark.read.schema(f"{self.MANIFEST}, fingerprint string").parquet(f"{self.root}/runs")
        fields = [f.name for f in rows.schema.fields if f.name not in ("fingerprint", "run_id")]
        last = F.max_by(F.struct(*fields), F.struct("committed", "commit")).alias("r")
        return rows.groupBy("fingerprint", "run_id").agg(last).select("run_id", "fingerprint", *[F.col(f"r.{f}").alias(f) for f in fields])

    def runs(self) -> DataFrame:
        return self._committed().select("run_id", "started_at", "fingerprint", "months", "n_kpis")

    def kpis(self, fp: str | None = None) -> DataFrame:
        """KPIs of committed runs; of one fingerprint, only its folder is read."""
        held = self.spark.read.schema("run_id string, kpi_id string, value double, unit string, commit string, fingerprint string").parquet(
            f"{self.root}/run_kpis")
        done = self._committed().select("fingerprint", "commit")
        if fp is not None:
            held, done = held.where(F.col("fingerprint") == fp), done.where(F.col("fingerprint") == fp)
        return held.join(done, ["fingerprint", "commit"], "left_semi").select("run_id", "kpi_id", "value", "unit")

    def previous(self, fp: str, run_id: str) -> DataFrame:
        """Latest earlier run with the same fingerprint and at least one KPI; reads that fingerprint's manifest."""
        same = self.runs().filter((F.col("fingerprint") == fp) & (F.col("run_id") != run_id) & (F.col("n_kpis") > 0))
        return same.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(1)

    def list_runs(self) -> DataFrame:
        return self.runs().orderBy(F.col("started_at").desc())


def _folder(fp: str) -> str:
    """A fingerprint is hexadecimal; anything else could not be a folder's name."""
    if not re.fullmatch(r"[\w.-]+", fp):
        raise ValueError(f"no fingerprint: {fp!r}")
    return fp
