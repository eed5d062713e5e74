"""Operator 5: fuzzy line deduplication by MinHash.

A line is compared in its normal form (white space runs as one blank, trimmed,
lower case), as the set of its distinct character shingles. Equal lines are
one node. Signatures of min-wise hashes are cut into bands; lines that share a
band meet, are verified by exact Jaccard similarity of their shingle sets, and
links are closed to components by star contraction. Of every component the
first occurrence stays, by doc_id, then the row's hash, then the place in it;
the other lines are taken out of their texts.

At the threshold of 0.8, 16 bands of 5 hashes let a linked pair meet with
probability 1 - (1 - 0.8^5)^16 = 0.998, and more above it.

Edge cases: lines of fewer than ``LEAST`` characters in normal form are
structure, not content: they always stay. A null text stays null, an empty one
empty. Rows are told apart by their id and text: rows equal in both get the
same result, as one document. Null ids come after all others. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm import meet
from veritable.llm.common import prepare_python, shared_table
from veritable.llm.ngram_join import mixed

SHINGLE, LEAST, PER_CENT = 8, 20, 80
BANDS, HASHES = 16, 5
#: Hashes of a signature that must agree in the later rounds before a pair is verified. At the threshold 64 of 80 agree on
#: average; fewer than 52 do with probability 0.0006.
AGREE = 52
#: Characters whose hashes are worked on at a time: they stay in a core's cache.
PART = 1 << 16
#: Pairs of a task group that are verified at a time, and lines times shingles that are marked at a time.
PAIRS, CELLS = 64, 1 << 22
#: Rows of a tile that are compared with all of another tile at a time, and rows up to which a task group's pairs are taken at once.
BLOCK, SMALL = 64, 48
_RNG = np.random.default_rng(20240611)
_ODD = _RNG.integers(0, 2**31, BANDS * HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WHITE = "\t\r\v\f\x1c\x1d\x1e\x1f"  # of ASCII, without blank and line end
_SIZES = [1 << k for k in range(SHINGLE.bit_length() - 1)]  # SHINGLE is a power of two


def normal(line: str) -> str:
    if "  " in line or not line.isprintable() or line[:1] == " " or line[-1:] == " ":  # the only printable white space is the blank
        line = " ".join(line.split())
    return line.lower()


def normal_lines(text: str) -> list[str] | None:
    """``normal`` of all lines of a text at once, where no line has white space to be changed; else None."""
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ":
        return None
    if any(c in text for c in _WHITE) if text.isascii() else not text.replace("\n", "").isprintable():
        return None
    low = text.lower()
    return low.split("\n") if len(low) == len(text) else None


def line_id(line: str) -> int:
    out = xxhash.xxh3_64_intdigest(line)
    return out - (1 << 64) if out >> 63 else out


def _lines(text: str | None) -> list[tuple[int, str]]:
    """(place, normal form) of the lines that are long enough."""
    if not text:
        return []
    if (lines := normal_lines(text)) is not None:
        return [(place, line) for place, line in enumerate(lines) if len(line) >= LEAST]
    return [(place, own) for place, line in enumerate(text.split("\n")) if len(line) >= LEAST and len(own := normal(line)) >= LEAST]


def line_texts(docs: DataFrame) -> DataFrame:
    """(row, id, place, node, line) of the long lines of (row, id, text); of equal lines that meet in a batch one has its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_lines(text) for text in batch.column("text").to_pylist()]
            doc = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            nodes = [line_id(line) for x in found for _, line in x]
            seen: set[int] = set()
            lines = [None if n in seen else seen.add(n) or line for n, (_, line) in zip(nodes, (y for x in found for y in x), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(doc), batch.column("id").take(doc), pa.array([k for x in found for k, _ in x], pa.int32()),
                 pa.array(nodes, pa.int64()), pa.array(lines, pa.string())], ["row", "id", "place", "node", "line"])

    return docs.select("row", "id", "text").mapInArrow(run, "row long, id long, place int, node long, line string")


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every character shingle in order, shingles of each text); every text has one at least."""
    h = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    inside = np.ones(len(h), bool)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    for size in _SIZES:  # from the hashes of so many characters to those of twice as many
        longer = h[:-size] * np.uint64(pow(int(_STEP), size, 1 << 64))
        longer += h[size:]
        h = longer
    h = h[np.flatnonzero(inside)]
    return mixed(h), sizes - SHINGLE + 1


def signatures(texts: list[str]) -> np.ndarray:
    """Min-wise hashes of each text's character shingles, one row a text (uint32)."""
    h, own = shingle_hashes(texts)
    h = (h >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum(own) - own
    out, turned = np.empty((len(_ODD), len(texts)), np.uint32), np.empty_like(h)
    for i, odd in enumerate(_ODD):  # each odd factor permutes the 32-bit hashes
        np.multiply(h, odd, out=turned)
        np.minimum.reduceat(turned, at, out=out[i])
    return out.T


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, one row a text."""
    bands = np.ascontiguousarray(signature.T).reshape(BANDS, HASHES, len(signature))
    key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(signature), axis=1)
    for k in range(HASHES):
        key = mixed(key * _STEP + bands[:, k])
    return np.ascontiguousarray(key.T).view(np.int64)


def _parts(nodes: list[int], texts: list[str], limit: int = PART) -> Iterator[tuple[list[int], list[str]]]:
    a, size = 0, 0
    for k, t in enumerate(texts):
        if k > a and size + len(t) > limit:
            yield nodes[a:k], texts[a:k]
            a, size = k, 0
        size += len(t)
    if len(texts) > a:
        yield nodes[a:], texts[a:]


def line_keys(docs: DataFrame) -> DataFrame:
    """(key, node): the band keys that several long lines of (text) share; equal lines that meet in a task give theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        seen: set[int] = set()
        for batch in batches:
            fresh: dict[int, str] = {}
            for text in batch.column("text").to_pylist():
                for _, line in _lines(text):
                    node = line_id(line)
                    if node not in seen:
                        seen.add(node)
                        fresh[node] = line
            for own, part in _parts(list(fresh), list(fresh.values())):
                yield band_keys(signatures(part)).ravel(), np.repeat(np.array(own, np.int64), BANDS)

    return meet.shared_keys(docs.select("text"), run)


def line_points(each: DataFrame) -> DataFrame:
    """(node, size, point, extra): the signatures and texts of (node, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, part in _parts(batch.column("node").to_pylist(), batch.column("line").to_pylist()):
                found = np.ascontiguousarray(signatures(part)).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), pa.array([len(t) for t in part], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, len(_ODD), dtype=np.int32)),
                                              pa.array(found.ravel())), pa.array(part, pa.string())],
                    ["node", "size", "point", "extra"])

    return each.select("node", "line").mapInArrow(run, "node long, size long, point array<int>, extra string")


def screen(sizes: np.ndarray, comp: np.ndarray, side: np.ndarray, points: np.ndarray, same: bool
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of a task group, of different components, whose signatures agree in at least ``AGREE`` places, with that number.

    Of two such nodes one at least is outside the group's largest component, so
    that component's rows are not compared with each other. The low bytes of
    the signatures, which agree at least as often, are compared first.
    """
    if len(sizes) <= SMALL:
        i, j = np.nonzero(comp[:, None] != comp)
        keep = i < j if same else side[i] < side[j]
        i, j = i[keep], j[keep]
        agree = (points[i] == points[j]).sum(axis=1)
        keep = agree >= AGREE
        return i[keep], j[keep], agree[keep]
    _, own, many = np.unique(comp, return_inverse=True, return_counts=True)
    rare = own != many.argmax()
    left = np.arange(len(sizes)) if same else np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    blocks = [(left, right[rare[right]])] if same else [(left, right[rare[right]]), (left[rare[left]], right[~rare[right]])]
    low = np.ascontiguousarray((points & 0xFF).astype(np.uint8).T)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for some, others in blocks:
        there = low[:, some]
        for at in range(0, len(others) if len(some) else 0, BLOCK):
            j = others[at:at + BLOCK]
            agree = np.zeros((len(j), len(some)), np.uint8)
            equal = np.empty(agree.shape, bool)
            for x, y in zip(low[:, j], there, strict=True):
                agree += np.equal(x[:, None], y, out=equal).view(np.uint8)
            q, p = np.nonzero(agree >= AGREE)
            a.append(some[p])
            b.append(j[q])
    i, j = np.concatenate(a), np.concatenate(b)
    keep = own[i] != own[j]
    if same:
        keep &= (i < j) | ~rare[i]
    i, j = i[keep], j[keep]
    agree = np.concatenate([np.empty(0, np.int64), *((points[i[at:at + 4096]] == points[j[at:at + 4096]]).sum(axis=1)
                                                     for at in range(0, len(i), 4096))])
    keep = agree >= AGREE
    return i[keep], j[keep], agree[keep]


def shingles(line: str) -> set[str]:
    return {line[i:i + SHINGLE] for i in range(len(line) - SHINGLE + 1)}


def alike(x: set[str], y: set[str]) -> bool:
    both = len(x & y)
    return 100 * both >= PER_CENT * (len(x) + len(y) - both)


def alike_pairs(left: list[str], right: list[str]) -> np.ndarray:
    """``alike`` of the pairs of lines; at most 2^16 pairs. Shingles are compared by their hashes' upper 47 bits.

    A pair so near the threshold that clashing hashes could decide is weighed by its shingles.
    """
    n = len(left)
    h, many = shingle_hashes([*left, *right])
    pair = np.repeat(np.tile(np.arange(n, dtype=np.uint64), 2), many) << np.uint64(48)
    h = pair | (h >> np.uint64(17) << np.uint64(1))
    h[int(many[:n].sum()):] |= np.uint64(1)  # the side
    h.sort()
    h = h[np.concatenate([[True], h[1:] != h[:-1]])]
    shared = h[1:][(h[1:] ^ h[:-1]) == 1]
    total, both = (np.bincount((x >> np.uint64(48)).astype(np.int64), minlength=n) for x in (h, shared))
    margin = 100 * both - PER_CENT * (total - both)
    out = margin >= 0
    for k in np.flatnonzero(np.abs(margin) <= 400):
        out[k] = alike(shingles(left[k]), shingles(right[k]))
    return out


def alike_among(lines: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``alike`` of the index pairs (i, j) of at most 2^16 lines, by their hashes as in ``alike_pairs``; a line may be in many pairs."""
    h, many = shingle_hashes(lines)
    h = h >> np.uint64(16) << np.uint64(16) | np.repeat(np.arange(len(lines), dtype=np.uint64), many)
    h.sort()
    h = h[np.concatenate([[True], h[1:] != h[:-1]])]
    line, h = (h & np.uint64(0xFFFF)).astype(np.int64), h >> np.uint64(16)
    many = np.bincount(line, minlength=len(lines))
    again = h[1:] == h[:-1]
    keep = np.append(again, False) | np.append(False, again)
    line, place = line[keep], np.cumsum(~np.append(False, again)[keep]) - 1  # shingles of several lines, numbered
    both = np.zeros(len(i), np.int64)
    wide = max(8, CELLS // len(lines))
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, wide):  # a bit a line and shingle
        a, b = np.searchsorted(place, (at, at + wide))
        held = np.zeros((len(lines), min(wide, int(place[-1]) + 1 - at)), bool)
        held[line[a:b], place[a:b] - at] = True
        bits = np.packbits(held, axis=1)
        both += np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64)
    margin = 100 * both - PER_CENT * (many[i] + many[j] - both)
    out = margin >= 0
    held: dict[int, set[str]] = {}
    for k in np.flatnonzero(np.abs(margin) <= 400).tolist():
        a, b = (held[x] if x in held else held.setdefault(x, shingles(lines[x])) for x in (int(i[k]), int(j[k])))
        out[k] = alike(a, b)
    return out


def verified(pairs: DataFrame) -> DataFrame:
    """(a, b) of the rows (a, line_a, b, line_b) whose shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                keep = alike_pairs(part.column("line_a").to_pylist(), part.column("line_b").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "line_a", "b", "line_b").mapInArrow(run, "a long, b long")


def joining(node, comp, lines: list[str], i: np.ndarray, j: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the index pairs of a task group those that are alike and join two components not yet joined in it, best first."""
    up = {int(c): int(c) for c in comp}

    def root(c: int) -> int:
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    sizes = np.array([len(x) for x in lines])
    order, out = np.argsort(-score, kind="stable"), []
    while len(order):  # some pairs at a time, by number and length; those of joined components need no look
        n = max(1, min(PAIRS, int(np.searchsorted(np.cumsum(sizes[i[order]] + sizes[j[order]]), 4 * PART))))
        some, order = order[:n], order[n:]
        some = [k for k, c, d in zip(some.tolist(), comp[i[some]].tolist(), comp[j[some]].tolist(), strict=True) if root(c) != root(d)]
        own, at = np.unique(np.concatenate([i[some], j[some]]), return_inverse=True)
        for k in np.array(some, int)[alike_among([lines[x] for x in own.tolist()], *at.reshape(2, -1))].tolist() if some else ():
            p, q = root(int(comp[i[k]])), root(int(comp[j[k]]))
            if p != q:
                up[p] = q
                out.append(k)
    return i[out], j[out]


def line_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) of all long lines of (row, id, text) that are linked with another one; (row, id, place, node) of all."""

    tables: dict[str, DataFrame] = {}

    def verify(pairs: DataFrame) -> DataFrame:
        held = shared_table(pairs, "pairs")
        nodes = held.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        lines = meet.marked(line_texts(docs), nodes, "node", "known").withColumn("line", F.when(F.col("known"), F.col("line"))).drop("known")
        tables["places"] = shared_table(lines, "places")  # one reading gives the places of all lines and the texts of some
        some = tables["places"].where("line IS NOT NULL").select("node", "line")
        found = tables["texts"] = shared_table(some.dropDuplicates(["node"]), "texts")
        side = {c: found.select(F.col("node").alias(c), F.col("line").alias(f"line_{c}")) for c in ("a", "b")}
        return verified(held.join(side["a"], "a").join(side["b"], "b"))

    def points(nodes: DataFrame, every: bool) -> DataFrame:
        return line_points(meet.only(tables["texts"], nodes, "node"))  # the first pairs hold every node that shares a key

    found = meet.components(line_keys(docs), verify, points, screen, joining)
    return found, tables["places"].drop("line")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its text's surviving lines, ``n_lines`` before and ``n_dropped``.

    All columns of ``docs`` come back, the text replaced, after the two counts
    (columns of the counts' names are replaced by them).
    """
    prepare_python(docs.sparkSession)
    text = F.col(text_col).cast("string")
    row = F.xxhash64(F.col(id_col).cast("long"), text)
    rows = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("id"), text.alias("text"))
    found, places = line_components(rows)
    found = shared_table(found, "found")
    places = places.join(found, "node", "left").select("row", "id", "place", F.coalesce("component", "node").alias("comp"))
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("row"), F.col("place"))
    firsts = places.groupBy("comp").agg(F.min(order).alias("first"), F.max(order).alias("end"))
    firsts = firsts.where("first <> end").select("comp", "first")
    gone = places.join(firsts, "comp").where(~order.eqNullSafe(F.col("first")))
    gone = gone.groupBy("row").agg(F.collect_set("place").alias("gone"))
    names = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    held = docs.select(row.alias("_row"), text.alias("_text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_own"))
    out = held.join(gone.withColumnRenamed("row", "_row").hint("shuffle_hash"), "_row", "left")
    each_line = F.split("_text", "\n", -1)
    stay = F.array_join(F.filter(each_line, lambda x, i: ~F.array_contains("gone", i)), "\n")
    return out.select(
        F.coalesce(F.size(each_line), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("_text")).otherwise(stay).alias(text_col),
        *[F.col("_own").getField(c).alias(c) for c in names])
