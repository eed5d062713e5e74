"""Operators 2 and 7 against brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritable.llm import ball_tree, int8_tiles, vectors


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    out = [(int(i), (centres[i % 6] + 0.2 * rng.normal(size=16)).tolist()) for i in range(700)]
    out += [(700 + i, out[5][1]) for i in range(40)]  # one common vector
    out += [(900, None), (901, []), (902, [float("nan")] * 16), (903, [1.0, None] * 8), (904, [float("inf")] * 16),
            (905, [0.0] * 16), (None, out[0][1]), (3, out[3][1]), (950, [1.0, 2.0])]
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    wide = [(*r, "x", 1, 2) for r in rows]
    return spark.createDataFrame(wide, "vec_id long, embedding array<double>, dim string, shard int, score int")


def usable(rows, zeros):
    seen = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zeros or any(v)):
            seen[i] = v
    return seen


def small(monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 120)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(int8_tiles, "TILE", 50)
    monkeypatch.setattr(ball_tree, "LEAF", 8)


def test_top_k(frame, rows, monkeypatch):
    small(monkeypatch)
    own = {i: np.floor(256 * np.array(v)).astype(int) for i, v in usable(rows, True).items()}
    want = set()
    for q in (i for i in own if i % 50 == 0):
        near = sorted((-int(own[q] @ own[c]), c) for c in own if c != q and len(own[c]) == len(own[q]))
        want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(near[:5])}
    got = ball_tree.top_k(frame, F.col("vec_id") % 50 == 0, 5, scale=256.0).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def plain_distance(x, y):
    """Squares added one after the other: the built-in sum() makes up for rounding since Python 3.12."""
    total = 0.0
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        total += (a - b) * (a - b)
    return math.sqrt(total)


def test_nearest(frame, rows, monkeypatch):
    small(monkeypatch)
    own = {i: np.array(v) for i, v in usable(rows, False).items()}
    want = {}
    for q in (i for i in own if i % 100 == 0):
        near = sorted((plain_distance(own[q], own[c]), c) for c in own if c != q and len(own[c]) == len(own[q]))
        want |= {(q, r + 1): (c, d) for r, (d, c) in enumerate(near[:10])}
    got = int8_tiles.nearest(frame, F.col("vec_id") % 100 == 0, 10).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(30, 8)) * 10, rng.normal(size=(40, 8)) * 0.01
    low, high = int8_tiles.tile_bounds(int8_tiles.quantised(x), int8_tiles.quantised(y))
    exact = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    assert (low <= exact).all() and (exact <= high).all()


def test_few_and_none(spark, frame):
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ball_tree.top_k(two, F.col("vec_id") == 0, 5).collect()] == [(0, 1, 1, 1)]
    assert [r.vec_id for r in int8_tiles.nearest(two, F.col("vec_id") == 0, 5).collect()] == [1]
    none = frame.where("false")
    assert ball_tree.top_k(none, F.col("vec_id") == 0, 5).collect() == []
    assert int8_tiles.nearest(none, F.col("vec_id") == 0, 5).collect() == []


def test_large_whole_numbers_stay_exact(spark):
    big = spark.createDataFrame([(0, [2.0**27 + 1, 3.0]), (1, [2.0**27 + 1, 5.0])], "vec_id long, embedding array<double>")
    got = ball_tree.top_k(big, F.col("vec_id") == 0, 1).first()
    assert got.score == (2**27 + 1) ** 2 + 15


def test_huge_components_stay_candidates():
    """Squares beyond the range of doubles leave no bound; such rows are still weighed."""
    vecs = [[1e200, 0.0], [1.0, 2.0], [1.5, 2.0], [-1e200, 1.0], [1e160, 1e160], [1.0, 1.0]]
    kind = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64()))])
    cand = pa.table({"vec_id": list(range(len(vecs))), "v": vecs}, schema=kind)
    for q, own in enumerate(vecs):
        with np.errstate(over="ignore"):
            far = [(float(int8_tiles.distances(np.array([v]), np.array(own))[0]), c) for c, v in enumerate(vecs) if c != q]
            found = int8_tiles._searcher(3)(cand, cand.slice(q, 1))
        assert sorted(zip(found[2], found[1], strict=True)) == sorted(far)[:3]
