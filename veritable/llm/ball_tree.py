"""Operator 2: exact top-k inner-product search with ball trees.

Rows are dealt to shards. In a shard a ball tree is built over the vectors
(centre and radius of each node); a query's inner product with any vector of a
node is at most q.c + |q| r. Nodes are visited in the order of that bound, and
the search of a shard ends when the best bound left is below the query's k-th
score. That score is shared: each query is first searched in one shard, and
its k-th score from there is the bar in all shards from the start.

Scores are integers, computed exactly: vectors are scaled and floored first.

Edge cases: vectors that are null, empty or hold null or non-finite components
take no part; neither do rows without an id. Repeated rows count once. A query
is compared with rows of other ids and the same number of components. Fewer
candidates than k: all of them. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.llm.common import shared_table
from veritable.llm.vectors import best, grid, matrix, search_grid, valid_rows

LEAF = 96
#: Products of integers below this, over a vector of any practical length, are exact in double precision.
EXACT = 2.0**21


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a with b, from whole numbers held as doubles."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < EXACT:
        return (a @ b).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in a], object)
    return np.array(whole @ np.array([int(x) for x in b], object), np.int64)


class BallTree:
    """Nodes as arrays: centre, radius, children (0: none) and the range of rows in ``order``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, np.arange(len(points))
        centres, radii, spans, children = [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            a, b, parent = todo.pop()
            own = points[self.order[a:b]]
            centre = own.mean(axis=0)
            away = np.sqrt(((own - centre) ** 2).sum(axis=1))
            me = len(centres)
            if parent >= 0:
                children[parent].append(me)
            centres.append(centre)
            radii.append(away.max())
            spans.append((a, b))
            children.append([])
            if b - a > leaf and radii[-1] > 0:
                p = own[away.argmax()]
                q = own[((own - p) ** 2).sum(axis=1).argmax()]
                side = own @ (q - p)
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(side, half)]
                todo += [(a, a + half, me), (a + half, b, me)]
        self.centres, self.radii, self.spans, self.children = np.stack(centres), np.array(radii), spans, children

    def search(self, q: np.ndarray, ids: np.ndarray, own: int, k: int, bar: float) -> list[tuple[int, int]]:
        """The k best (score, -id) above or at ``bar``; ``own`` is the query's id, which is no candidate."""
        bound = self.centres @ q + self.radii * np.sqrt(q @ q)
        bound += 0.5 + 1e-9 * np.abs(bound)  # scores are whole; covers rounding
        queue, top = [(-bound[0], 0)], []
        while queue:
            high, node = heapq.heappop(queue)
            if -high < (top[0][0] if len(top) == k else bar):
                break
            if self.children[node]:
                for c in self.children[node]:
                    heapq.heappush(queue, (-bound[c], c))
                continue
            a, b = self.spans[node]
            rows = self.order[a:b]
            scores = exact_products(self.points[rows], q)
            least = top[0][0] if len(top) == k else bar
            for s, i in zip(scores[scores >= least].tolist(), ids[rows[scores >= least]].tolist(), strict=True):
                if i == own:
                    continue
                if len(top) < k:
                    heapq.heappush(top, (s, -i))
                elif (s, -i) > top[0]:
                    heapq.heapreplace(top, (s, -i))
        return top


def _searcher(k: int):
    def search(cand: pa.Table, ask: pa.Table):
        points, ids = matrix(cand), cand.column("vec_id").to_numpy()
        tree = BallTree(points)
        out = []
        for own, q, bar in zip(ask.column("vec_id").to_pylist(), matrix(ask), ask.column("bar").to_pylist(), strict=True):
            found = tree.search(q, ids, own, k, float("-inf") if bar is None else bar)
            out += [(own, -i, s) for s, i in found]
        return tuple(zip(*out, strict=True)) if out else ([], [], [])

    return search


def top_k(df: DataFrame, is_query: Column, k: int, scale: float | None = None, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k largest integer inner products of every query row.

    ``scale``: components become floor(scale * x); None: they are whole numbers.
    """
    rows = valid_rows(df, id_col, vec_col)
    if scale is not None:
        rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")))
    rows = shared_table(rows, "vectors")
    cand, ask, shards, blocks = grid(rows, is_query)
    if shards == 1:
        return best(search_grid(cand, ask.withColumn("bar", F.lit(None).cast("long")), _searcher(k), "long"), k, True)
    home = F.pmod(F.col("block"), F.lit(shards)) == F.col("shard")
    first = search_grid(cand.where(home), ask.where(home).withColumn("bar", F.lit(None).cast("long")), _searcher(k), "long")
    bars = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bar")).where(F.col("n") >= k)
    bars = shared_table(bars.select(F.col("query_id").alias("vec_id"), "bar"), "bars")
    found = search_grid(cand, ask.join(bars, "vec_id", "left"), _searcher(k), "long")
    return best(found, k, True)
