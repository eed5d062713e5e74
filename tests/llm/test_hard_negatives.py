"""Operator 12 against brute force over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritable.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score int, dim string, row int, shard int, slot string"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "s") for r in rows], SCHEMA).repartition(parts)


def brute(rows, anchor, positives=5, negatives=5, least=80, most=100, scale=256.0):
    seen = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            seen[(i, tuple(v), label)] = [int(np.floor(scale * x)) for x in v]
    out = set()
    for (i, v, label), own in seen.items():
        if not anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(own, w, strict=True)), c[0], c[2]) for c, w in seen.items() if c[0] != i and len(w) == len(own)]
        best = sorted((-s, c) for s, c, x in scored if x == label)[:positives]
        for p, c in best:
            inside = sorted((-s, n) for s, n, x in scored if x != label and least * -p <= 100 * s <= most * -p)[:negatives]
            out |= {(i, c, k + 1, n, -p, -s) for k, (s, n) in enumerate(inside)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(7, 12))
    out = [(int(i), (centres[i % 7] + 0.6 * rng.normal(size=12)).tolist(), int(rng.integers(0, 4))) for i in range(900)]
    out += [(1_000 + i, out[5][1], i % 3) for i in range(60)]  # one common vector, three labels: ties
    out += [(2_000 + i, (centres[0] + 0.1 * rng.normal(size=12)).tolist(), 0) for i in range(300)]  # a hot label
    out += [(3_000, None, 1), (3_001, [], 1), (3_002, [float("nan")] * 12, 1), (3_003, [1.0, None] * 6, 1), (3_004, [float("inf")] * 12, 2),
            (3_005, [0.0] * 12, 2), (None, out[0][1], 1), (3, out[3][1], out[3][2]), (3_100, [1.0, 2.0], 1), (3_101, [1.0, 2.5], 1),
            (3_102, [0.9, 2.0], 2), (3_200, out[7][1], None), (3_300, [1.0] * 5, 1)]
    return out


def test_against_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 150)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "STEP", 3)
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()
    want = brute(rows, lambda i: i % 20 == 0)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 200


def test_other_limits(spark, rows):
    got = hard_negatives.mine(frame(spark, rows[:300]), F.col("vec_id") % 10 == 3, positives=3, negatives=4, least=-50, most=93, scale=16.0).collect()
    want = brute(rows[:300], lambda i: i % 10 == 3, 3, 4, -50, 93, 16.0)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 0


def test_slots_answer_every_window():
    """A window's first k rows are the first k of the suffix of slots, for any limits."""
    rng = np.random.default_rng(4)
    for _ in range(50):
        score, ids = rng.integers(0, 40, 200), rng.permutation(200)
        edges = sorted(set(rng.integers(5, 45, 5).tolist()), reverse=True)
        slots = []
        for j, top in enumerate(edges):
            at = np.flatnonzero((score <= top) & ((score > edges[j + 1]) if j + 1 < len(edges) else True))
            slots.append([(-int(score[i]), int(ids[i])) for i in at[hard_negatives.best_of(score[at], ids[at], 5)]])
        for j, top in enumerate(edges):
            low = int(0.8 * top)
            want = sorted((-int(s), int(i)) for s, i in zip(score, ids, strict=True) if low <= s <= top)[:5]
            suffix = [x for own in slots[j:] for x in own][:5]
            assert [x for x in suffix if -x[0] >= low] == want


def test_large_components(spark):
    big = [(0, [2.0**27 + 1, 3.0], 1), (1, [2.0**27 + 3, 5.0], 1), (2, [2.0**27 + 2, 5.0], 2), (3, [2.0**27, 5.0], 2), (4, [2.0**27 + 3, 6.0], 3)]
    got = {tuple(r) for r in hard_negatives.mine(frame(spark, big), F.col("vec_id") == 0, scale=1.0).collect()}
    assert got == brute(big, lambda i: i == 0, scale=1.0) and len(got) == 2
    huge = [(0, [1e200, 1.0], 1), (1, [1e200, 2.0], 1), (2, [1e200, 0.0], 2), (3, [-1e308, 0.0], 2)]
    got = hard_negatives.mine(frame(spark, huge), F.col("vec_id") == 0).collect()
    top = 2**63 - 1
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, top, top)]  # beyond 64 bits: the nearest number


def test_nothing_to_find(spark, rows):
    assert hard_negatives.mine(frame(spark, rows).where("false"), F.col("vec_id") == 0).collect() == []
    assert hard_negatives.mine(frame(spark, rows), F.col("vec_id") == -1).collect() == []
    alone = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2)]
    assert hard_negatives.mine(frame(spark, alone), F.col("vec_id") == 0).collect() == []
