"""Operator 12: hard negatives by slot-decomposed selection.

An anchor's positives are its best rows of the same label; every positive asks
for the best rows of other labels whose scores lie in a window below its own
score. The windows of an anchor overlap. Their upper limits split the scores
into disjoint slots, from the highest limit down: slot j holds the scores of at
most limit j and above limit j + 1, the last slot all below. A window is then
the slots from its own on, cut at its lower limit, and its k best rows are
among the k best of each of these slots. So

1. positives are found in a grid of (label, shard, block of anchors);
2. in a grid of (shard, block of anchors) each task keeps the k best rows of
   every slot of its anchors, whatever the number of rows in a slot; the same
   combiner merges the tasks' rows;
3. an anchor's slots, laid one after the other, are in descending order: the
   answer of a window is the first k of the suffix that begins with its slot,
   without those below its lower limit.

A grid's groups are bounded by a shard and a block, and a common label is many
shards. Both are large, because each row goes to every block of anchors, and
each anchor to every shard: with n rows that is n * n / 100 / 4,096 rows and
n * n / 100 / 16,384 anchors, for n * n / 100 scores.

Scores are whole numbers and exact: doubles as long as every sum stays below
2^53, Python integers beyond. A score outside 64 bits counts as the nearest
64-bit number.

Edge cases: rows with a null id, label or vector, an empty vector, or a null
or non-finite component take no part. Repeated rows count once; rows that share
an id are not each other's candidates. Only vectors of the same length meet.
Anchors without positives, and positives whose window holds nothing, give no
row; a negative positive score has an empty window. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritable.llm.common import shared_table, ship_package
from veritable.llm.vectors import matrix

#: Rows of a shard, anchors of a block, and anchors whose scores are in memory at a time.
SHARD_ROWS, BLOCK_ANCHORS, STEP = 16_384, 4_096, 256
LONGEST = 2**63 - 1


def whole(t: pa.Table, scale: float) -> np.ndarray:
    """floor(scale * x) of a table's vectors, as doubles."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(scale * matrix(t)))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles: doubles where all sums fit, else Python integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2.0**53:
        return a @ b.T
    exact = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    return np.clip(exact[0] @ exact[1].T, -LONGEST - 1, LONGEST)


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best: highest score, ties to the smaller id."""
    if len(score) > 8 * k:  # ties with the k-th stay in
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def limits(score: np.ndarray, least: int, most: int) -> tuple[list, list]:
    """(lower, upper) whole scores of each positive's window: least * p <= 100 * s <= most * p."""
    exact = [int(s) for s in score]
    return [-(-least * p // 100) for p in exact], [most * p // 100 for p in exact]


def _dealt(rows: DataFrame, is_anchor: Column, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(candidates, anchors) of the grid with one group of keys ``by``, shard and block each."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_anchor, 1)).alias("asked"))
    sizes = sizes.where("asked > 0").select(
        *by, F.greatest(F.lit(1), F.ceil(F.col("n") / SHARD_ROWS)).alias("shards"),
        F.greatest(F.lit(1), F.ceil(F.col("asked") / BLOCK_ANCHORS)).alias("blocks"))
    own = rows.join(sizes, by)
    shard = F.pmod(F.xxhash64("vec_id"), F.col("shards"))
    block = F.pmod(F.xxhash64(F.xxhash64("vec_id")), F.col("blocks"))
    cand = own.withColumn("shard", shard).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    ask = own.where(is_anchor).withColumn("block", block)
    ask = ask.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    return cand, ask


def _grid(cand: DataFrame, ask: DataFrame, keys: list[str], search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return search(left, right)

    # Both sides come from one table: new column ids for one of them, so that the cogroup can tell them apart.
    ask = ask.select(*[F.col(c).alias(c) for c in ask.columns])
    return cand.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInArrow(run, schema)


FOUND = "anchor long, anchor_row long, slot int, place int, vec_id long, score long"


def _positives(k: int, scale: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best rows of a group for each of its anchors."""

    def search(cand: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if cand.num_rows and ask.num_rows:
            rows, anchors = whole(cand, scale), whole(ask, scale)
            ids, own, key = cand.column("vec_id").to_numpy(), ask.column("vec_id").to_numpy(), ask.column("row").to_numpy()
            for a in range(0, len(own), STEP):
                scores = inner(anchors[a:a + STEP], rows)
                for j, score in enumerate(scores, a):
                    at = np.flatnonzero(ids != own[j])
                    out += [(own[j], key[j], 0, 0, ids[i], score[i]) for i in at[best_of(score[at], ids[at], k)]]
        return _found(out)

    return search


def _slots(k: int, scale: float, least: int, most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best rows of other labels in every slot of each anchor."""

    def search(cand: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if cand.num_rows and ask.num_rows:
            rows, anchors = whole(cand, scale), whole(ask, scale)
            ids, label = cand.column("vec_id").to_numpy(), cand.column("label").combine_chunks().dictionary_encode()
            own, key = ask.column("vec_id").to_numpy(), ask.column("row").to_numpy()
            code = {x: i for i, x in enumerate(label.dictionary.to_pylist())}
            label, theirs = label.indices.to_numpy(), [code.get(x, -1) for x in ask.column("label").to_pylist()]
            positives = ask.column("positives").to_pylist()
            for a in range(0, len(own), STEP):
                scores = inner(anchors[a:a + STEP], rows)
                for j, score in enumerate(scores, a):
                    low, high = limits(positives[j], least, most)
                    edges = sorted(set(high), reverse=True)
                    at = np.flatnonzero((score <= edges[0]) & (score >= min(low)) & (label != theirs[j]) & (ids != own[j]))
                    for slot, top in enumerate(edges):
                        inside = score[at] <= top
                        if slot + 1 < len(edges):
                            inside &= score[at] > edges[slot + 1]
                        here = at[inside]
                        out += [(own[j], key[j], slot, 0, ids[i], score[i]) for i in here[best_of(score[here], ids[here], k)]]
        return _found(out)

    return search


def _found(rows: list[tuple]) -> pa.Table:
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table([pa.array([int(x) for x in c], kind) for c, kind in zip(columns, kinds, strict=True)], names)


def _combined(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each (anchor, slot); ``place`` counts them from 1."""
    order = Window.partitionBy("anchor", "anchor_row", "slot").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100,
         scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``vec_id``. A negative's score s lies in
    least * p <= 100 * s <= most * p of the positive's score p.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL").where((F.size("v") > 0) & F.coalesce(fine, F.lit(False))).distinct()
    rows = rows.select("vec_id", F.size("v").alias("dim"), "label", "v", F.xxhash64("label", "v").alias("row"))
    rows = shared_table(rows, "vectors")

    cand, ask = _dealt(rows, is_anchor, ["dim", "label"])
    found = _grid(cand, ask, ["dim", "label", "shard", "block"], _positives(positives, scale), FOUND)
    best = shared_table(_combined(found, positives).select("anchor", "anchor_row", "vec_id", "score"), "positives")

    each = best.groupBy("anchor", "anchor_row").agg(F.collect_list("score").alias("positives"))  # at most ``positives`` a list
    cand, ask = _dealt(rows, is_anchor, ["dim"])
    ask = ask.join(each, (F.col("vec_id") == F.col("anchor")) & (F.col("row") == F.col("anchor_row")))
    found = _grid(cand, ask, ["dim", "shard", "block"], _slots(negatives, scale, least, most), FOUND)
    slots = _combined(found, negatives)
    return _windows(best, slots, negatives, least, most)


def _windows(best: DataFrame, slots: DataFrame, k: int, least: int, most: int) -> DataFrame:
    """Every positive's first k rows of the suffix of slots that begins with its own."""
    anchor = ["anchor", "anchor_row"]
    laid = slots.groupBy(*anchor).agg(F.sort_array(F.collect_list(F.struct("slot", "place", "vec_id", "score"))).alias("laid"))
    upper = F.floor(F.col("score").cast("decimal(38,0)") * most / 100)
    lower = F.ceil(F.col("score").cast("decimal(38,0)") * least / 100)
    own = best.withColumn("upper", upper)
    edges = own.groupBy(*anchor).agg(F.sort_array(F.collect_set("upper"), asc=False).alias("edges"))
    own = own.join(edges, anchor).withColumn("own_slot", F.expr("array_position(edges, upper) - 1")).withColumn("lower", lower)
    own = own.join(laid, anchor)
    suffix = F.slice(F.filter("laid", lambda x: x["slot"] >= F.col("own_slot")), 1, k)
    window = F.filter(suffix, lambda x: (x["score"] >= F.col("lower")) & (x["score"] <= F.col("upper")))
    flat = own.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(window).alias("at", "x"))
    return flat.select(F.col("anchor").alias("anchor_id"), "positive_id", (F.col("at") + 1).cast("int").alias("rank"),
                       F.col("x.vec_id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"))
