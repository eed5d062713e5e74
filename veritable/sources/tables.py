"""Catalogue of the driver tables (one parquet file each)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from veritable.functions.exprs import nan_to_null

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


# Schemas of tables already read, by path. Schema inference reads a parquet
# footer in a Spark job on every ``spark.read.parquet``; a catalogue table
# carries its schema instead. Passing the known schema skips that job, and
# each call still returns a fresh relation (own attribute ids, safe to
# self-join). The driver tables are read-only, so a path's schema is fixed.
_SCHEMAS: dict[str, StructType] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table, NaN as NULL; Catalyst prunes columns and pushes filters."""
    path = table_path(sf_dir, name)
    schema = _SCHEMAS.get(path)
    if schema is None:
        df = spark.read.parquet(path)
        _SCHEMAS[path] = df.schema
        return nan_to_null(df)
    return nan_to_null(spark.read.schema(schema).parquet(path))


def load_all(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: load(spark, sf_dir, name) for name in TABLES if os.path.exists(table_path(sf_dir, name))}


def register_views(spark: SparkSession, sf_dir: str) -> None:
    for name, df in load_all(spark, sf_dir).items():
        df.createOrReplaceTempView(name)
