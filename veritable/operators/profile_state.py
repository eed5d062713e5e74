"""Profiles that follow a folder's files (a new file costs a scan of that file).

The state of a file is what its profile is made of and what can be added up:
the histogram of every column (numbers in their own type, the rest as text) and
the moments of every number column. It is keyed by the file's path, size and
modification time, so a changed file is a new one and a deleted file no longer
counts. A profile adds up the states of the files that are there now; files
without a state are scanned first.

States are written a batch of files at a time, and a batch counts only once its
files stand in the manifest, which is written last: a refresh that dies on the
way leaves nothing that a later one would read. Tables with the same columns
share nothing: a state folder belongs to one path.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritable.functions.exprs import nan_to_null
from veritable.operators import profile as P

FILE = ["_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time"]
MOMENTS = ["n", "low", "high", "mean", "m2", "m3", "total", "zeros", "negatives"]


class ProfileState:
    """Profiles of the table at ``path``, with states in ``folder``."""

    def __init__(self, spark: SparkSession, path: str, folder: str, fmt: str = "parquet", schema: str | None = None, **options):
        self.spark, self.path, self.folder, self.fmt, self.schema, self.options = spark, path, folder.rstrip("/"), fmt, schema, options

    def _table(self) -> DataFrame:
        reader = self.spark.read.format(self.fmt).options(**self.options)
        return (reader.schema(self.schema) if self.schema else reader).load(self.path)

    def files(self) -> DataFrame:
        """(file, path) of the files that are there now; none is opened. ``file`` is the key of the state."""
        listed = self.spark.read.format("binaryFile").load(self.path)
        return listed.select(F.xxhash64(*FILE).alias("file"), F.col(FILE[0]).alias("path"), F.col(FILE[1]).alias("size")).where("size > 0").drop("size")

    def _manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema("file long, batch string").parquet(f"{self.folder}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # nothing written so far
                raise
            return self.spark.createDataFrame([], "file long, batch string")

    def _part(self, name: str, schema: str) -> DataFrame:
        """States of the files that are there now."""
        try:
            held = self.spark.read.schema(f"{schema}, batch string").parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        live = self._manifest().join(self.files().select("file"), "file", "left_semi").dropDuplicates(["file"])
        return held.join(live, ["file", "batch"], "left_semi").drop("batch")

    def refresh(self) -> list[str]:
        """Scan the files that have no state yet; their paths."""
        known = self._manifest().select("file").distinct()
        new = [r["path"] for r in self.files().join(known, "file", "left_anti").select("path").collect()]  # a name a new file
        if not new:
            return []
        table = self._table()
        rows = table if known.isEmpty() else table.where(F.col(FILE[0]).isin(new))  # other files are left out when Spark lists them
        rows = rows.select("*", F.xxhash64(*FILE).alias("_file"))
        rows, batch, names = nan_to_null(rows), uuid.uuid4().hex, [n for n in table.columns if P.type_kind(table.schema[n].dataType) != "other"]
        numeric = [n for n in names if P.type_kind(table.schema[n].dataType) == "numeric"]
        other = [n for n in names if n not in numeric]
        if other:
            text = rows.select("_file", *[F.col(n).cast("string").alias(n) for n in other]).unpivot(["_file"], other, "column_name", "value")
            hist = text.groupBy(F.col("_file").alias("file"), "column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
            hist.write.parquet(f"{self.folder}/text/batch={batch}")
        if numeric:
            hist = P.typed_histogram(rows, numeric, F.col("_file")).withColumnRenamed("_key0", "file")
            hist.write.parquet(f"{self.folder}/numbers/batch={batch}")
            typed = self.spark.read.parquet(f"{self.folder}/numbers/batch={batch}")
            moments(typed).write.parquet(f"{self.folder}/moments/batch={batch}")
        done = rows.select(F.col("_file").alias("file")).distinct()
        empty = self.files().where(F.col("path").isin(new)).select("file")  # files without a row
        done.union(empty).distinct().withColumn("batch", F.lit(batch)).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        return sorted(new)

    def profile(self, roles: dict[str, str] | None = None) -> DataFrame:
        """R8/R10 over the files that are there now: the rows of ``profile.profile_dataset``."""
        self.refresh()
        table = self._table()
        facts = None
        text = self._part("text", "file long, column_name string, value string, cnt long")
        numbers = self._part("numbers", "file long, column_name string, w long, f double, d string, cnt long")
        for hist, keys, build in ((text, ["column_name", "value"], P.text_facts), (numbers, ["column_name", "w", "f", "d"], P.numeric_facts)):
            part = build(table, hist.groupBy(*keys).agg(F.sum("cnt").alias("cnt")))
            facts = part if facts is None else facts.unionByName(part)
        return P.profile_rows(facts, roles)

    def numeric_stats(self) -> DataFrame:
        """R5 without the median, from added moments: (column_name, n, min, max, mean, std, sum, zeros, negatives, skew)."""
        self.refresh()
        each = self._part("moments", "file long, column_name string, " + ", ".join(f"{m} {'long' if m in ('n', 'zeros', 'negatives') else 'double'}" for m in MOMENTS))
        total = each.groupBy("column_name").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("middle"))
        each = each.join(total, "column_name").withColumn("away", F.col("mean") - F.col("middle"))  # one row a file and column
        n, away = F.col("n"), F.col("away")
        summed = each.groupBy("column_name").agg(
            F.sum("n").alias("n"), F.min("low").alias("min"), F.max("high").alias("max"), F.first("middle").alias("mean"),
            F.sum(F.col("m2") + n * away * away).alias("m2"), F.sum(F.col("m3") + 3 * away * F.col("m2") + n * away * away * away).alias("m3"),
            F.sum("total").alias("sum"), F.sum("zeros").alias("zeros"), F.sum("negatives").alias("negatives"))
        rows, std = F.col("n").cast("double"), F.sqrt(F.col("m2") / (F.col("n") - 1))
        g1 = F.col("m3") / rows / F.pow(F.col("m2") / rows, F.lit(1.5))
        return summed.select(
            "column_name", "n", "min", "max", "mean", F.when(F.col("n") > 1, std).otherwise(0.0).alias("std"), "sum", "zeros", "negatives",
            F.when(F.col("n") > 2, F.when(F.col("m2") <= 0, 0.0).otherwise(g1 * F.sqrt(rows * (rows - 1)) / (rows - 2))).alias("skew"))


def moments(hist: DataFrame) -> DataFrame:
    """Moments of every file and column of a typed histogram: sums about the file's own mean."""
    x, c = F.coalesce(F.col("w").cast("double"), "f", F.col("d").cast("double")), F.col("cnt")
    rows = hist.select("file", "column_name", x.alias("x"), c).where("x IS NOT NULL")
    middle = rows.groupBy("file", "column_name").agg((F.sum(F.col("x") * c) / F.sum(c)).alias("mean"))
    away = F.col("x") - F.col("mean")
    return rows.join(middle, ["file", "column_name"]).groupBy("file", "column_name").agg(
        F.sum(c).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.first("mean").alias("mean"),
        F.sum(c * away * away).alias("m2"), F.sum(c * away * away * away).alias("m3"), F.sum(F.col("x") * c).alias("total"),
        F.sum(F.when(F.col("x") == 0, c).otherwise(0)).alias("zeros"), F.sum(F.when(F.col("x") < 0, c).otherwise(0)).alias("negatives"))
