"""Operator 7: nearest neighbours by a block matrix join of int8 tiles.

Every vector is quantised to int8 with its own scale; the length of what was
rounded off is kept. A tile of int8 products gives the distances between the
quantised vectors, and by the triangle inequality a vector's true distance is
within the two rounding lengths of it. In a tile, a query's k-th smallest upper
bound rules out every candidate whose lower bound is larger; the pairs that
survive are recomputed in double precision and merged into the query's heap,
whose k-th distance then serves the next tile. So nothing is lost to the
quantisation: the result is exact.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components take no part; neither do rows without an id. Repeated rows count
once. A query is compared with rows of other ids and the same number of
components. Fewer candidates than k: all of them. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from veritable.llm.common import shared_table
from veritable.llm.vectors import best, grid, matrix, search_grid, valid_rows

TILE = 2_048


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, length of the rounding) of each row; a row is about scale * codes."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0  # below the smallest normal number: all is rounding
    codes = np.rint(x / scale[:, None]).clip(-127, 127).astype(np.int8)
    return codes, scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))


def tile_bounds(q, x) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the distances between two lists of quantised vectors.

    Where squares leave the range of doubles nothing is known: 0 and infinity.
    """
    (qc, qs, qe), (xc, xs, xe) = q, x
    kind = np.float32 if qc.shape[1] * 127 * 127 < 2**24 else np.float64  # whole products, exact in either
    products = (qc.astype(kind) @ xc.astype(kind).T).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        q2, x2 = ((c.astype(np.float64) ** 2).sum(axis=1) * s**2 for c, s in ((qc, qs), (xc, xs)))
        square = q2[:, None] + x2[None, :] - 2.0 * products * qs[:, None] * xs[None, :]
        slack = 1e-12 * (q2[:, None] + x2[None, :])
        away = qe[:, None] + xe[None, :]
        low = np.sqrt(np.maximum(square - slack, 0.0)) - away
        high = np.sqrt(np.maximum(square, 0.0) + slack) + away
    known = np.isfinite(low) & np.isfinite(high)
    low, high = np.where(known, low, 0.0), np.where(known, high, np.inf)
    return low * (1 - 1e-9) - 1e-300, high * (1 + 1e-9) + 1e-300


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, squares added in the order of the components."""
    total = np.zeros(len(x))
    for a, b in zip(x.T, q, strict=True):
        total += (a - b) ** 2
    return np.sqrt(total)


def _searcher(k: int):
    def search(cand: pa.Table, ask: pa.Table):
        points, ids = matrix(cand), cand.column("vec_id").to_numpy()
        queries, own = matrix(ask), ask.column("vec_id").to_numpy()
        coded = quantised(queries)
        heaps: list[list[tuple[float, int]]] = [[] for _ in own]
        for a in range(0, len(points), TILE):
            x, x_ids = points[a:a + TILE], ids[a:a + TILE]
            low, high = tile_bounds(coded, quantised(x))
            other = x_ids[None, :] != own[:, None]
            low[~other], high[~other] = np.inf, np.inf
            bar = np.partition(high, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(own), np.inf)
            for j, heap in enumerate(heaps):
                if len(heap) == k:
                    bar[j] = min(bar[j], -heap[0][0])
                at = np.flatnonzero((low[j] <= bar[j]) & other[j])
                exact = distances(x[at], queries[j])
                for d, i in zip(exact.tolist(), x_ids[at].tolist(), strict=True):
                    if len(heap) < k:
                        heapq.heappush(heap, (-d, -i))
                    elif (-d, -i) > heap[0]:
                        heapq.heapreplace(heap, (-d, -i))
        out = [(q, -i, -d) for q, heap in zip(own.tolist(), heaps, strict=True) for d, i in heap]
        return tuple(zip(*out, strict=True)) if out else ([], [], [])

    return search


def nearest(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k smallest Euclidean distances of every query row."""
    rows = shared_table(valid_rows(df, id_col, vec_col, zeros=False), "vectors")
    cand, ask, _, _ = grid(rows, is_query)
    return best(search_grid(cand, ask, _searcher(k), "double"), k, False)
