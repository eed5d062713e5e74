"""What the two vector searches share: valid rows, the grid of shards and query blocks, and the last merge."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritable.llm.common import ship_package

#: Rows of a shard and queries of a block; one task group holds one of each.
SHARD_ROWS, BLOCK_QUERIES = 16_384, 1_024


def valid_rows(df: DataFrame, id_col: str, vec_col: str, zeros: bool = True) -> DataFrame:
    """Distinct (vec_id, dim, v) rows whose vector is not null or empty and has only finite components."""
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where((F.size("v") > 0) & F.coalesce(fine, F.lit(False)))
    if not zeros:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.distinct().select("vec_id", F.size("v").alias("dim"), "v")


def grid(rows: DataFrame, is_query: Column, extra: list[str] | None = None) -> tuple[DataFrame, DataFrame, int, int]:
    """(candidates, queries, shards, blocks): rows of every shard for every query block, and the other way round.

    The queries are a stated set; every candidate has to meet every query, in
    blocks, and each task group is bounded by a shard and a block.
    """
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_queries // BLOCK_QUERIES))
    own = F.xxhash64("vec_id")
    cand = rows.withColumn("shard", F.pmod(own, F.lit(shards)).cast("int"))
    cand = cand.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    ask = rows.where(is_query).withColumn("block", F.pmod(F.xxhash64(own), F.lit(blocks)).cast("int"))
    ask = ask.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return cand, ask, shards, blocks


def matrix(t: pa.Table) -> np.ndarray:
    return t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)


def search_grid(cand: DataFrame, ask: DataFrame, search: Callable[[pa.Table, pa.Table], tuple], score: str) -> DataFrame:
    """(query_id, vec_id, score) found by ``search(candidates, queries)`` in every group of the grid."""
    ship_package(cand.sparkSession)
    kind = pa.int64() if score == "long" else pa.float64()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v, s = search(left, right) if left.num_rows and right.num_rows else ([], [], [])
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, kind)})

    keys = ["dim", "shard", "block"]
    # Both sides come from one table: new column ids for one of them, so that the cogroup can tell them apart.
    ask = ask.select(*[F.col(c).alias(c) for c in ask.columns])
    return cand.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInArrow(run, f"query_id long, vec_id long, score {score}")


def best(found: DataFrame, k: int, largest: bool) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of each query, ties to the smaller id.

    A query has at most k rows a shard here.
    """
    order = [F.col("score").desc() if largest else F.col("score").asc(), F.col("vec_id").asc()]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
