"""Components of a similarity join whose candidates meet by exact keys.

Input: rows (key, node) such that every two similar nodes share a key. Rounds
keep the work in proportion to the rows even where thousands of nodes share a
key:

1. In each key the smallest node is the key's leader; every other node is
   verified against its leaders. That finds the bulk of dense groups with one
   pair a node, and gives first components.
2. What is left to find are links between nodes of *different* components that
   share a key without the leader joining them. Only keys that still hold two
   components go on. Their rows are cut into tiles of bounded size, every pair
   of a key's tiles is one task group, and an index over the group's points
   screens the pairs before they are verified. First only the ``TOP`` most
   promising pairs of every two components that meet in a group are verified,
   so that two large components that belong together are joined by a few pairs
   and not by all their pairs. A group that holds more pairs of two components
   marks its key as crowded.
3. The crowded keys again, with every pair that is left and was not verified
   before: after it no two nodes that share a key and pass the screen are
   untested, unless they are already in one component.

Where links are verified inside the task groups, one round takes all pairs, and
two nodes are compared at the smallest key they share.

Two similar nodes often share many keys, and most of these hold the same nodes.
Of the keys that hold the same nodes (equal number and two equal 64-bit sums of
hashes) a round takes the smallest one, so that a pair is not found once a key.

No key, however common, is held by one task: leaders come from a window whose
buffer spills, and tiles are bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritable.llm.common import connected_components, ranges, shared_table

#: Rows of a key that one task group holds, and ids up to which a semi-join sends them to every executor (8 bytes each).
TILE, SENT_IDS = 1_500, 2_000_000

#: Keys that a task packs at a time, and that one packed row holds (16 bytes each with its node).
HELD, PACK = 1 << 20, 1 << 11

#: Pairs of every two components that a task group gives before all that are left are asked for.
TOP = 4

#: Columns of a task group that are numbers, the first three name the group.
NUMBERS = ("key", "t1", "t2", "tile", "node", "low", "comp", "size")

Local = Callable[[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
Screen = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool], tuple[np.ndarray, np.ndarray, np.ndarray]]


def only(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``ids`` (distinct, same name): by broadcast if they are few, else by shuffle."""
    ids = shared_table(ids, "ids")
    few = ids.count() <= SENT_IDS
    return df.join(F.broadcast(ids) if few else ids, column, "left_semi")


def marked(df: DataFrame, ids: DataFrame, column: str, mark: str) -> DataFrame:
    """``df`` with ``mark``: true where ``column`` is in ``ids``, as ``only`` finds it, else null."""
    ids = shared_table(ids, "ids")
    few = ids.count() <= SENT_IDS
    ids = ids.withColumn(mark, F.lit(True))
    return df.join(F.broadcast(ids) if few else ids, column, "left")


def shared_keys(rows: DataFrame, found: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(key, node) of the keys that two different nodes have; ``found`` gives arrays of keys and of their nodes for a task's batches.

    Most keys have one node, so that a row a key would be shuffled for nothing
    but to be dropped. Each task packs its keys by the partition they belong to,
    and each partition sorts what comes in.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for pair in found(batches):
            held.append(pair)
            if sum(len(key) for key, _ in held) >= HELD:
                yield _packed(held, parts)
                held = []
        if held:
            yield _packed(held, parts)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
        fresh: list[np.ndarray] = []
        n = 0
        for batch in batches:
            fresh.append(np.frombuffer(b"".join(batch.column("pairs").to_pylist()), np.int64).reshape(-1, 2))
            n += len(fresh[-1])
            if n >= max(4 * HELD, len(rest[0])):
                out, rest = _several(rest, fresh)
                fresh, n = [], 0
                yield from out
        if fresh:
            yield from _several(rest, fresh)[0]

    packed = rows.mapInArrow(pack, "part int, pairs binary").repartitionById(parts, "part")
    return packed.select("pairs").mapInArrow(several, "key long, node long")


def _packed(held: list[tuple[np.ndarray, np.ndarray]], parts: int) -> pa.RecordBatch:
    """(part, pairs): keys and nodes in turn as bytes, at most ``PACK`` pairs a row."""
    key, node = (np.concatenate(x) for x in zip(*held, strict=True))
    part = (key.view(np.uint64) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int32)  # 16 bits sort faster
    order = np.argsort(part, kind="stable")
    pairs = np.stack([key[order], node[order]], axis=1)
    many = np.bincount(part, minlength=parts)
    rows = -(-many // PACK)
    first = ranges(np.zeros(parts, np.int64), rows) * PACK + np.repeat(np.cumsum(many) - many, rows)
    at = pa.array(np.append(first, len(key)).astype(np.int32) * 16)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(parts, dtype=np.int32), rows)),
                                       pa.Array.from_buffers(pa.binary(), len(first), [None, at.buffers()[1], pa.py_buffer(pairs)])],
                                      ["part", "pairs"])


def _several(rest: tuple[np.ndarray, np.ndarray, np.ndarray], fresh: list[np.ndarray]
             ) -> tuple[Iterator[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows of keys that several nodes have, as far as they were not given before, and one row of each key, whether it was given."""
    pairs = np.concatenate(fresh)
    key, node = np.concatenate([rest[0], pairs[:, 0]]), np.concatenate([rest[1], pairs[:, 1]])
    given = np.concatenate([rest[2], np.zeros(len(pairs), bool)])
    order = np.argsort(key)
    again = key[order][1:] == key[order][:-1]
    more = np.append(again, False) | np.append(False, again) if len(key) else again
    alone, some = order[~more], order[more]
    some = some[np.lexsort((~given[some], node[some], key[some]))]
    k, n = key[some], node[some]
    some = some[np.append(True, (k[1:] != k[:-1]) | (n[1:] != n[:-1]))] if len(some) else some
    first = np.flatnonzero(np.append(True, key[some][1:] != key[some][:-1])) if len(some) else some
    many = np.diff(np.append(first, len(some)))
    out = some[np.repeat(many > 1, many) & ~given[some]]
    given[some[first[many > 1]]] = True
    stay = np.concatenate([alone, some[first]])
    batches = (pa.RecordBatch.from_arrays([pa.array(key[x]), pa.array(node[x])], ["key", "node"])
               for x in (out[a:a + HELD] for a in range(0, len(out), HELD)))
    return batches, (key[stay], node[stay], given[stay])


def components(keys: DataFrame, verify: Callable[[DataFrame], DataFrame], points: Callable[[DataFrame, bool], DataFrame],
               screen: Screen, local: Local | None = None) -> DataFrame:
    """(node, component) of all nodes with a link.

    ``verify`` takes pairs (a, b) and returns the linked ones. ``points`` takes
    distinct nodes, and whether every pair is asked for, and returns (node,
    size, point array); the points may be finer where every pair is.
    ``screen(sizes, comp, side, points, same)`` returns the index pairs of a
    task group that lie in different components and may be linked, with a score
    (higher: more promising); ``side`` is 0 for the rows of the first tile and
    1 for those of the second. With ``local``, ``points`` also gives a string
    ``extra``, and ``local(node, comp, extra, i, j, score)`` verifies the
    screened pairs inside the task and returns the links that join two
    components there: then one later round does it all, and only links leave
    the tasks.
    """
    both = Window.partitionBy("key")
    dealt = keys.repartition("key")  # most keys have one node: they are grouped by hash, and one shuffle serves both sides
    several = dealt.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    shared = dealt.join(several.select("key", "low").hint("shuffle_hash"), "key")
    shared = shared_table(shared.select("key", "node", "low").distinct(), "meet")
    first = shared.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    links = shared_table(verify(first), "links")
    found, tested, crowded = _closed(links), None, None
    for top in (TOP, None) if local is None else (None,):
        own = shared if crowded is None else only(shared, crowded, "key")
        own = own.join(found, "node", "left").select("key", "node", "low", F.coalesce("component", "node").alias("comp"))
        spread = own.withColumn("c1", F.min("comp").over(both)).withColumn("c2", F.max("comp").over(both))
        left = shared_table(spread.where("c1 <> c2").select("key", "node", "low", "comp"), "left")
        if crowded is None:
            left = _one_key_a_set(left)
        if left.isEmpty():
            break
        met = shared_table(_candidates(left, points, screen, top, local), "met")
        pairs = met.select("a", "b").distinct()
        if tested is not None:
            pairs = shared_table(pairs, "pairs")  # distinct first: Spark would put it after the join
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        tested = shared_table(pairs, "tested")
        more = tested if local is not None else shared_table(verify(tested), "links")
        if not more.isEmpty():
            links = shared_table(links.select("a", "b").unionByName(more.select("a", "b")), "links")
            found = _closed(links)
        crowded = met.where("more").select("key").distinct()
    return found


def _closed(links: DataFrame) -> DataFrame:
    return shared_table(connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "found")


def _one_key_a_set(rows: DataFrame) -> DataFrame:
    """The rows (key, node, ..) of one key, the smallest, of those that hold the same nodes."""
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                   F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    kept = held.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    return shared_table(only(rows, kept, "key"), "left")


def _candidates(left: DataFrame, points, screen: Screen, top: int | None, local: Local | None) -> DataFrame:
    """(key, a, b, more) of the tiles of every key: of each two components the ``top`` most promising pairs, all, or the links.

    ``more``: the group holds further pairs of these components.
    """
    both = Window.partitionBy("key")
    held = shared_table(points(left.select("node").distinct(), top is None), "points")
    rows = left.join(held.select("node", "size"), "node")
    if local:  # a node has few keys where links are verified in the groups
        held = held.join(left.groupBy("node").agg(F.collect_set("key").alias("keys")), "node")
    number = Window.partitionBy("key").orderBy("size", "node")
    rows = rows.withColumn("tile", F.floor((F.row_number().over(number) - 1) / TILE).cast("int"))
    rows = rows.withColumn("tiles", F.max("tile").over(both))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles"))))
    rows = rows.join(held.drop("size"), "node")
    rows = rows.select("key", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile",
                       "node", "low", "comp", "size", "point", *(["keys", "extra"] if local else []))
    spots = rows.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2", "tile", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        held = 0
        for group in _groups(batches):
            found = _pairs(group, screen, top, local)
            if len(found[0]):
                out.append(found)
                held += len(found[0])
            if held > 50_000:
                yield _batch(out)
                out, held = [], 0
        if out:
            yield _batch(out)

    return spots.mapInArrow(run, "key long, a long, b long, more boolean")


def _batch(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["key", "a", "b", "more"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of the runs of rows with the same (key, t1, t2); a run may go over batches."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = {c: batch.column(c).to_numpy() for c in NUMBERS}
        cols["point"] = batch.column("point").flatten().to_numpy().reshape(n, -1)
        for c in batch.schema.names:
            if c not in cols:
                cols[c] = np.empty(n, object)
                cols[c][:] = batch.column(c).to_pylist()
        name = [cols[c] for c in NUMBERS[:3]]
        edges = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in name])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), n], strict=True):
            if held and any(held[-1][c][0] != cols[c][a] for c in NUMBERS[:3]):
                yield _joined(held)
                held = []
            held.append({c: v[a:b] for c, v in cols.items()})
    if held:
        yield _joined(held)


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def _pairs(rows: dict[str, np.ndarray], screen: Screen, top: int | None, local: Local | None) -> tuple[np.ndarray, ...]:
    """(key, a, b, more) of a task group that pass the screen, lie in different components, and were not verified in round 1."""
    node, comp, low = rows["node"], rows["comp"], rows["low"]
    same = rows["t1"][0] == rows["t2"][0]
    i, j, score = screen(rows["size"], comp, (rows["tile"] != rows["t1"]).astype(int), rows["point"], same)
    keep = (node[i] != low[i]) & (node[j] != low[j])
    if not keep.any():
        return (node[:0],) * 4
    i, j, score = i[keep], j[keep], score[keep]
    more = np.zeros(len(i), bool)
    if top is not None and len(i):
        c, d = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
        order = np.lexsort((-score, d, c))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (c[order][1:] != c[order][:-1]) | (d[order][1:] != d[order][:-1])
        starts = np.flatnonzero(fresh)
        many = np.diff(np.append(starts, len(order)))
        chosen = np.arange(len(order)) - np.repeat(starts, many) < top
        more = np.repeat(many > top, many)[chosen]
        i, j = i[order[chosen]], j[order[chosen]]
    elif len(i) and local is not None:  # of the keys that two nodes share, the smallest one gives the pair
        key = rows["key"][0]
        before = [{k for k in keys if k < key} for keys in rows["keys"]]
        first = np.fromiter((before[a].isdisjoint(before[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
        i, j = local(node, comp, rows["extra"].tolist(), i[first], j[first], score[first])
        more = np.zeros(len(i), bool)
    return np.repeat(rows["key"][:1], len(i)), np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), more
