"""Operator 9: n-gram Jaccard join by count vectors in R-trees.

A document's set is its distinct 4-word shingles (64-bit hashes). Shingles are
hashed into groups; the counts of a set's shingles in the groups are a point.
Two sets overlap in at most the sum of the smaller counts, so pairs of points
(and whole R-tree nodes, by their largest counts) whose sum is below what the
similarity needs are ruled out; the pairs that remain are verified on whole
texts.

So that the trees can be searched on many machines, documents first meet by
group *contents*: sets of size up to m that are similar enough differ in at
most D = 15 * 2m / 185 shingles, so of more than D groups at least one holds
the same shingles in both. Each size band has its own number of groups; a set
near a band's upper end also signs in the next band. A set with so many empty
groups that the argument needs one of these signs with its D + 1 smallest
shingles instead (of two similar sets, one is among both's smallest). No
similar pair is missed. Copies collapse before anything else: a node is a
distinct set, not a document.

Edge cases: a text that is null, empty or without words has an empty set and
no link; with one to three words its whole sequence is one shingle. Rows that
share a doc_id count as one document for components; each gives a row with its
own set size. A row with a null id is returned with a null component and links
nothing. Other columns are ignored. Set and shingle hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritable.llm import meet
from veritable.llm.common import connected_components, free_name, prepare_python, shared_table, text_chunks

WORDS, PER_CENT = 4, 85
DIMENSIONS, FAN = 128, 16
#: Groups of the points by which every pair of a crowded key is screened, and such pairs weighed at a time.
FINE, PAIRS = 8 * DIMENSIONS, 4096
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RANDOM = np.random.default_rng(20240607).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * _FOLD
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word in order, first word of each text and the end)."""
    data = [t.encode("utf-8", "replace") for t in texts]
    b = np.frombuffer(b" ".join([*data, b""]).translate(LOWER), np.uint8)
    inner = (b != 32) & ((b < 9) | (b > 13))
    edge = np.diff(np.concatenate([[0], inner.view(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    base = np.cumsum([0, *(len(d) + 1 for d in data)])
    first = np.searchsorted(start, base)
    if not len(start):
        return np.empty(0, np.uint64), first
    size = stop - start
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    power = np.cumprod(np.full(int(size.max()) + 1, _STEP | np.uint64(1), np.uint64))
    sums = np.add.reduceat(_RANDOM[b[inner]] * power[place], at)
    return mixed(sums + size.astype(np.uint64) * _FOLD), first


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, first = word_hashes([t or "" for t in texts])
    joint = h.copy()
    for k in range(1, words):
        joint[: len(h) - k] = mixed(joint[: len(h) - k] * _STEP + h[k:])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(joint[a:b - words + 1]))
        elif b > a:
            one = np.uint64(b - a)
            for k in range(a, b):
                one = mixed(np.array([one]) * _STEP + h[k])[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes()), np.uint64).view(np.int64))


def point(s: np.ndarray, groups: int = DIMENSIONS) -> np.ndarray:
    """Shingles in each group. (32 bits: a text has fewer than 2^31 bytes.)"""
    return np.bincount((mixed(s) % np.uint64(groups)).astype(np.int64), minlength=groups).astype(np.int32)


def needed(a, b):
    """The least overlap of linked sets with a and b members: 100 * i >= 85 * (a + b - i)."""
    return -(-PER_CENT * (a + b) // (100 + PER_CENT))


class Bands:
    """Size bands: (first size, end, differences D of linked sets whose larger one is in the band, groups)."""

    def __init__(self) -> None:
        self.bands: list[tuple[int, int, int, int]] = []
        self._grow()

    def _grow(self) -> None:
        low = self.bands[-1][1] if self.bands else 1
        high = max(low + 1, low * 3 // 2)
        d = 2 * (100 - PER_CENT) * (high - 1) // (100 + PER_CENT)
        self.bands.append((low, high, d, d + 1 + max(1, ceil(0.12 * (d + 1)))))

    def of(self, size: int) -> list[int]:
        """The bands in which a set of this size signs."""
        while self.bands[-1][1] <= size * 100 // PER_CENT:
            self._grow()
        k = next(i for i, b in enumerate(self.bands) if b[1] > size)
        return [k, k + 1] if size * 100 // PER_CENT >= self.bands[k][1] else [k]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Signatures of a set: one a group and band, of the group's contents."""
        out = []
        for k in self.of(len(s)) if len(s) else []:
            _, _, d, groups = self.bands[k]
            if not d:
                continue  # only equal sets are linked, and these are one node
            spread = mixed(s * _FOLD + np.uint64(k))
            group = (spread % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            there, at = np.unique(group[order], return_index=True)
            sums = np.add.reduceat(mixed(spread[order]), at)
            out.append(mixed(sums + mixed((there.astype(np.uint64) << np.uint64(8)) + np.uint64(k))))
            if len(there) <= d:  # so many groups are empty that the others may all differ
                out.append(mixed(np.sort(mixed(s))[:d + 1] * _STEP + np.uint64(k)))
        return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


class CountRTree:
    """A packed R-tree over count vectors: boxes of ``FAN`` children, sorted by size and then by the largest coordinate.

    A box keeps its largest counts and its range of sizes. ``search`` returns
    the points whose overlap bound with a query reaches what linked sets need,
    ``search_all`` those of several queries.
    """

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        self.order = np.lexsort((points.argmax(axis=1), sizes))
        top, low, high = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(top, low, high)]
        while len(top) > FAN:
            at = np.arange(0, len(top), FAN)
            top, low, high = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))

    def search(self, size: int, q: np.ndarray) -> np.ndarray:
        return self.search_all(np.array([size]), q[None])[1]

    def search_all(self, sizes: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point of the tree) index pairs that the bound allows; the queries go down the tree together."""
        last = len(self.levels[-1][0])
        query, found = np.repeat(np.arange(len(sizes)), last), np.tile(np.arange(last), len(sizes))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            size = sizes[query]
            near = (high[found] * 100 >= PER_CENT * size) & (low[found] * PER_CENT <= 100 * size)
            query, found, size = query[near], found[near], size[near]
            bound = np.minimum(top[found], points[query]).sum(axis=1, dtype=np.int64)
            near = bound >= needed(size, np.maximum(low[found], -(-PER_CENT * size // 100)))
            query, found = query[near], found[near]
            if depth:
                found = (found[:, None] * FAN + np.arange(FAN)).ravel()
                query = np.repeat(query, FAN)
                there = found < len(self.levels[depth - 1][0])
                query, found = query[there], found[there]
        return query, self.order[found]


def screen(sizes: np.ndarray, comp: np.ndarray, side: np.ndarray, points: np.ndarray, same: bool
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of a task group, of different components, that the count bound cannot rule out, with its share of the larger size.

    One side's points are in the tree, the other side's are the queries. Finer
    points are searched by their sums in ``DIMENSIONS`` groups; then the pairs
    are weighed by all their counts.
    """
    sizes = sizes.astype(np.int64)
    left = np.arange(len(sizes)) if same else np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    whole, points = points, points.reshape(len(points), -1, DIMENSIONS).sum(axis=1, dtype=points.dtype)
    tree = CountRTree(sizes[left], points[left])
    a, b = [], []
    for at in range(0, len(right), FAN):
        some = right[at:at + FAN]
        query, hits = tree.search_all(sizes[some], points[some])
        j, hits = some[query], left[hits]
        keep = comp[hits] != comp[j]
        if same:
            keep &= hits < j
        a.append(hits[keep])
        b.append(j[keep])
    i, j = np.concatenate(a), np.concatenate(b)
    bound = np.concatenate([np.empty(0, np.int64), *(
        np.minimum(whole[i[at:at + PAIRS]], whole[j[at:at + PAIRS]]).sum(axis=1, dtype=np.int64) for at in range(0, len(i), PAIRS))])
    keep = bound >= needed(sizes[i], sizes[j])
    i, j = i[keep], j[keep]
    return i, j, bound[keep] / np.maximum(sizes[i], sizes[j])


def overlap_bound(a: Column, b: Column) -> Column:
    """Summed coordinate minima of two count vectors (arrays)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x.cast("int"))


def document_sets(docs: DataFrame) -> DataFrame:
    """(id, node, size, counts) of every (id, text) row; node is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches, "id", "text", 2 << 20):
            sets = shingle_sets(texts)
            counts = np.concatenate([point(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, len(counts) + 1, DIMENSIONS, dtype=np.int32)),
                                          pa.array(counts))], ["id", "node", "size", "counts"])

    return docs.mapInArrow(run, "id long, node long, size long, counts array<int>")


def fine_points(docs: DataFrame) -> DataFrame:
    """(node, point) of every (id, text) row with a set: its shingles in each of ``FINE`` groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batches, "id", "text", 2 << 20):
            sets = [s for s in shingle_sets(texts) if len(s)]
            counts = np.concatenate([np.empty(0, np.int32), *(point(s, FINE) for s in sets)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(
                    pa.array(np.arange(0, len(counts) + 1, FINE, dtype=np.int32)), pa.array(counts))], ["node", "point"])

    return docs.select("id", "text").mapInArrow(run, "node long, point array<int>")


def set_keys(docs: DataFrame) -> DataFrame:
    """(key, node): signatures of every distinct set; copies that meet in a task sign once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(), set()
        for _, texts in text_chunks(batches, "id", "text", 2 << 20):
            keys, nodes = [], []
            for s in shingle_sets(texts):
                node = set_id(s)
                if node not in seen:
                    seen.add(node)
                    keys.append(bands.keys(s))
                    nodes.append(np.full(len(keys[-1]), node))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))],
                                                 ["key", "node"])

    return docs.mapInArrow(run, "key long, node long")


def verified(pairs: DataFrame) -> DataFrame:
    """(a, b) of the rows (a, text_a, b, text_b) whose whole texts are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                keep = []
                left, right = (shingle_sets(part.column(c).to_pylist()) for c in ("text_a", "text_b"))
                nodes = zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)
                for (a, b), x, y in zip(nodes, left, right, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked = 100 * both >= PER_CENT * (len(x) + len(y) - both)
                    keep.append(linked and set_id(x) == a and set_id(y) == b)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: links of similarity 0.85 or more, closed to components."""
    prepare_python(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    own = shared_table(document_sets(rows), "sets")
    there = rows.where("id IS NOT NULL")
    nodes = own.where("id IS NOT NULL AND node IS NOT NULL").groupBy("node").agg(
        F.min("id").alias("rep"), F.first("size").alias("size"), F.first("counts").alias("counts"))
    nodes = shared_table(nodes, "nodes")

    def verify(pairs: DataFrame) -> DataFrame:
        side = {c: nodes.select(F.col("node").alias(c), F.col("rep").alias(f"rep_{c}"), F.col("size").alias(f"n_{c}"),
                                F.col("counts").alias(f"v_{c}")) for c in ("a", "b")}
        near = pairs.join(side["a"], "a").join(side["b"], "b")
        least = F.ceil(PER_CENT * (F.col("n_a") + F.col("n_b")) / (100 + PER_CENT))
        near = near.where(100 * F.least("n_a", "n_b") >= PER_CENT * F.greatest("n_a", "n_b"))
        near = shared_table(near.where(overlap_bound(F.col("v_a"), F.col("v_b")) >= least)
                            .select("a", "rep_a", "b", "rep_b"), "near")
        ids = near.select(F.explode(F.array("rep_a", "rep_b")).alias("id")).distinct()
        texts = meet.only(there, ids, "id")
        texts = {c: texts.select(F.col("id").alias(f"rep_{c}"), F.col("text").alias(f"text_{c}")) for c in ("a", "b")}
        return verified(near.join(texts["a"], "rep_a").join(texts["b"], "rep_b").select("a", "text_a", "b", "text_b")).distinct()

    def points(some: DataFrame, every: bool) -> DataFrame:
        if not every:
            return nodes.join(some, "node", "left_semi").select("node", "size", F.col("counts").alias("point"))
        chosen = shared_table(nodes.join(some, "node", "left_semi").select("node", "size", "rep"), "chosen")
        texts = meet.only(there, chosen.select(F.col("rep").alias("id")).distinct(), "id")
        return chosen.select("node", "size").join(fine_points(texts), "node").dropDuplicates(["node"])

    linked = meet.components(set_keys(there), verify, points, screen)
    linked = shared_table(linked.join(nodes.select("node", "rep"), "node"), "linked")
    heads = linked.groupBy("component").agg(F.min("rep").alias("head"))
    heads = nodes.select("node", "rep").join(linked.select("node", "component"), "node", "left").join(heads, "component", "left")
    heads = heads.select("node", F.coalesce("head", "rep").alias("head"))
    placed = shared_table(own.join(heads, "node", "left").select("id", "size", F.coalesce("head", "id").alias("head")), "placed")
    # Rows that share an id join the components of their sets.
    twice = placed.where("id IS NOT NULL").groupBy("id").agg(F.min("head").alias("src"), F.max("head").alias("dst"))
    bridges = placed.join(twice.where("src <> dst").select("id", "src"), "id").select("src", F.col("head").alias("dst"))
    joined = connected_components(bridges)
    out = placed.join(joined, F.col("head") == F.col("node"), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.coalesce("component", "head")).alias("component_id"))



def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the document of the smallest id stays.

    Of rows that share an id the one with the smallest text hash stays. Rows
    with a null id all stay.
    """
    found = shared_table(join(docs, id_col, text_col).where("doc_id IS NOT NULL"), "components")
    heads = found.where("component_id = doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    out = meet.only(docs, heads, id_col).unionByName(docs.where(F.col(id_col).isNull()))
    again = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(id_col))
    again = shared_table(again, "again")
    if again.isEmpty():
        return out
    order = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col), *[F.hash(F.col(f"`{c}`")) for c in docs.columns])
    place = free_name(docs, "place")
    some = out.join(again, id_col, "left_semi").withColumn(place, F.row_number().over(order))
    some = some.where(F.col(place) == 1).drop(place)
    return out.join(again, id_col, "left_anti").unionByName(some)
