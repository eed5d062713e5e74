"""The sink for cleaned tables (S6): an overwrite replaces the table as a whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from veritable.sources import readers as R


def test_a_failed_job_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    R.write_table(spark.range(5), path)
    with pytest.raises(Exception):
        R.write_table(spark.range(5).select(F.when(F.col("id") == 4, F.raise_error("broken")).otherwise("x").alias("id")), path)
    assert spark.read.parquet(path).count() == 5 and os.listdir(tmp_path) == ["t"]


def test_a_table_is_read_and_overwritten(spark, tmp_path):
    path = str(tmp_path / "t")
    R.write_table(spark.range(5), path)
    R.write_table(spark.read.parquet(path).where("id > 1"), path + "/")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3, 4] and os.listdir(tmp_path) == ["t"]


def test_a_table_set_aside_comes_back(spark, tmp_path):
    path = str(tmp_path / "t")
    R.write_table(spark.range(3), path)
    os.rename(path, path + ".veritable-before")  # as if the writer had died between the renames
    R.write_table(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7 and os.listdir(tmp_path) == ["t"]


def test_csv_and_append(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    R.write_table(spark.range(3), path, "csv")
    R.write_table(spark.range(2), path, "csv", mode="append")
    assert spark.read.option("header", True).csv(path).count() == 5
