"""Bag of little bootstraps for the difference of two means (Kleiner et al., 2014).

The rows of both groups are dealt to m bags, every row to one. A bag's rows are
resampled to the size of the whole group, many times; each resample gives a
difference of means, each bag an interval of them, and the mean of the bags'
intervals is the answer. Bags hold about n^0.7 rows and at least ``BAG_ROWS``,
so small groups are one bag: the plain bootstrap.

Equal values of a group come as one row with their number. A value that occurs
c times among m bags has c // m copies in each and one more in c mod m of them,
from a bag that its hash names. A copy's weight in a resample is Poisson(m), so
that of k copies is Poisson(k m), drawn from a hash of the value, the bag and
the resample: no row key is needed, and neither the order nor the layout of the
rows changes a draw. Nothing is multiplied in the plan: a task folds its rows
into an array of sums per bag and resample, and only these sums leave it.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.session import ship_package

#: Rows of a bag at least, resamples of a bag at least, and draws that a task holds at a time.
BAG_ROWS, BAG_RESAMPLES, DRAWS = 5_000, 100, 1_000_000


def bags(n: int, bag_rows: int = BAG_ROWS) -> int:
    """Number of bags for a group of n rows."""
    return max(1, int(n / max(bag_rows, n**0.7)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix (the finaliser of splitmix64): every bit of x changes half of the bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n numbers in [0, 1) for each hash; the same hash and seed give the same numbers."""
    step = np.uint64(0x9E3779B97F4A7C15) * (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed))
    return (mixed(hashes[:, None] + step[None, :]) >> np.uint64(11)).astype(np.float64) * 2.0**-53


@functools.lru_cache(maxsize=256)
def poisson_table(mean: int) -> tuple[int, np.ndarray]:
    """(first value, cumulated probabilities) of a Poisson distribution, out to where doubles see no more."""
    wide = int(10 * math.sqrt(mean) + 30)
    low = max(0, mean - wide)
    k = np.arange(low, mean + wide + 1, dtype=np.float64)
    log = np.concatenate([[0.0], np.cumsum(np.log(mean / k[1:]))])  # p(k) / p(k - 1) = mean / k
    p = np.exp(log - log.max())
    return low, np.cumsum(p) / p.sum()


def poisson(u: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Poisson numbers by inversion: a row of u for each mean."""
    out = np.empty(u.shape)
    for mean in np.unique(means).tolist():
        at = means == mean
        low, table = poisson_table(mean)
        out[at] = low + np.searchsorted(table, u[at], side="right")
    return out


def dealt(hashes: np.ndarray, counts: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bag, copies): the bags that each value is in, and with how many copies."""
    whole, rest = counts // m, counts % m
    n = np.where(whole > 0, m, rest)
    row = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first = (hashes % np.uint64(m)).astype(np.int64)
    return row, (first[row] + nth) % m, whole[row] + (nth < rest[row])


def fold(values: np.ndarray, counts: np.ndarray, hashes: np.ndarray, m: int, n: int, seed: int, sums: np.ndarray) -> None:
    """Add weights and weighted values of a group's rows to ``sums[0 or 1, bag, resample]``."""
    edges = np.flatnonzero(np.diff(np.cumsum(np.minimum(counts, m)) * n // DRAWS, prepend=-1))  # rows of about DRAWS draws
    for a, b in zip(edges, [*edges[1:], len(values)], strict=True):
        row, bag, copies = dealt(hashes[a:b], counts[a:b], m)
        order = np.argsort(bag, kind="stable")
        row, bag, copies = row[order], bag[order], copies[order]
        own = mixed(hashes[a:b][row] ^ mixed(bag.astype(np.uint64)))
        w = poisson(uniforms(own, n, seed), copies * m)
        starts = np.flatnonzero(np.diff(bag, prepend=-1))
        sums[0, bag[starts]] += np.add.reduceat(w, starts, axis=0)
        sums[1, bag[starts]] += np.add.reduceat(w * values[a:b][row][:, None], starts, axis=0)


def mean_difference_interval(rows: DataFrame, sizes: tuple[int, int], resamples: int, confidence: float, seed: int,
                             bag_rows: int = BAG_ROWS) -> DataFrame:
    """One row (low, high) for mean(side 0) - mean(side 1) of ``rows`` (side int, value double, no nulls).

    ``sizes``: rows of the two sides. A bag in which a side has no rows gives
    no interval; without any, low and high are NULL.
    """
    ship_package(rows.sparkSession)
    m = bags(min(sizes), bag_rows)
    n = max(BAG_RESAMPLES if m > 1 else 1, -(-resamples // m))
    hist = rows.groupBy("side", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            side, value, count, h = (batch.column(c).to_numpy() for c in ("side", "value", "n", "h"))
            for s in np.unique(side).tolist():
                at = side == s
                sums = held.setdefault(s, np.zeros((2, m, n)))
                fold(value[at], count[at], h[at].view(np.uint64), m, n, seed, sums)
        for s, sums in held.items():
            for bag in range(m):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, s), pa.int32()), pa.array(np.full(n, bag), pa.int32()), pa.array(np.arange(n), pa.int32()),
                     pa.array(sums[0, bag]), pa.array(sums[1, bag])], ["side", "bag", "resample", "w", "wx"])

    folded = hist.sortWithinPartitions("side", "h", "value").mapInArrow(run, "side int, bag int, resample int, w double, wx double")
    of = lambda c, s: F.sum(F.when(F.col("side") == s, F.col(c)))
    each = folded.groupBy("bag", "resample").agg(*[of(c, s).alias(f"{c}{s}") for c in ("w", "wx") for s in (0, 1)])
    each = each.where("w0 > 0 AND w1 > 0").select("bag", (F.col("wx0") / F.col("w0") - F.col("wx1") / F.col("w1")).alias("d"))
    tail = (1 - confidence) / 2
    ends = each.groupBy("bag").agg(F.percentile("d", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))  # n values a bag
    return ends.agg(F.avg(F.col("q")[0]).alias("low"), F.avg(F.col("q")[1]).alias("high"))
