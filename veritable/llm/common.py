"""Shared helpers of the training-data operators.

Reading a driver table, writing an intermediate table into the shared folder,
cutting Arrow batches into chunks of bounded bytes, packing per-row arrays,
and connected components by star contraction.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritable.session import ensure_checkpoint_dir, ship_package
from veritable.sources.tables import table_path

#: Bytes of text a Python task handles at a time (one longer text is a chunk of its own).
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def prepare_python(spark: SparkSession, rows: int = 512) -> None:
    """Executors get the package; rows of long texts go to Python in batches of at most ``rows``.

    The latter is a session setting, because Spark reads it when it plans the
    physical job.
    """
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the folder of ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage at a table every executor can read again after a loss.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_chunks(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str,
                limit: int = CHUNK_BYTES) -> Iterator[tuple[list[int], list[str | None]]]:
    """Whole (id, text) rows in chunks of about ``limit`` UTF-8 bytes; null ids are kept as None."""
    ids: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist(), strict=True):
            n = len(t) if t else 0
            if ids and size + n > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += n
    if ids:
        yield ids, texts


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges`` (src, dst).

    Alternating large-star / small-star contraction (Kiveris et al., 2014):
    every round is two grouped minima and two joins, so a node with a third of
    all edges is reduced inside the map tasks and its join is split by AQE.
    Self loops make a node a component of its own; null ends are dropped. No
    edge, label or component reaches the driver, only one row of checksums per
    round. Nodes without an edge are not returned.
    """
    pairs = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    pairs = pairs.where("src IS NOT NULL AND dst IS NOT NULL")
    pairs = shared_table(pairs.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(),
                         "cc")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = pairs.where("u <> v")
    seen = None
    for _ in range(max_rounds):
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low2.select("u", F.col("m").alias("v")))
        links = shared_table(small.where("u <> v").distinct(), "cc")
        now = links.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    roots = links.groupBy("u").agg(F.min("v").alias("r"))
    return nodes.join(roots, nodes.node == roots.u, "left").select(
        "node", F.coalesce("r", "node").alias("component"))
