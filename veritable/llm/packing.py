"""Operator 8: best-fit packing by minimum bin slack.

Texts are encoded and cut into pieces of at most one sequence. Bins are then
planned on the histogram of piece lengths, which has at most ``capacity``
rows whatever the corpus: the longest length left opens a bin, a bitset
subset-sum over the lengths left finds the fullest combination that still
fits, and the combination is removed as often as the counts allow. Since a
plan entry stands for any number of equal bins, the plan's size depends on
the capacity, not on the corpus. Pieces then take the plan's places by their
rank among the pieces of equal length; ranks come from counts per (length,
bucket), so no length, however common, is numbered by one task.

With a group column (the language, say) no sequence holds documents of two
groups: there is one histogram and plan a group, and groups are meant to be few.

Edge cases: a null or empty text is one piece holding only the end id; a null
id and repeated rows are packed like any row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritable.llm.common import prepare_python, shared_table, text_chunks
from veritable.llm.pieces import Chunk, piece_ids, special_ids, tokenizer_path

BYTE_TOKENIZER = "byte_bpe_50k.json"
CAPACITY, END_ID = 1024, 2
#: Pieces of one length are numbered in buckets of about this many rows, of at least ``LEAST_BUCKETS``.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
               text_col: str = "text", keep_ids: bool = False, group_col: str | None = None) -> DataFrame:
    """Encode each text, add ``end_id``, cut it so that only the first piece is shorter than ``capacity``.

    ``doc_id, piece, start, length, ids_crc32`` and, with ``keep_ids``, ``ids``, and with ``group_col`` that column as text.
    """
    prepare_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, specials = piece_ids(path), special_ids(path)
        for ids, texts in text_chunks(batches, "id", "text"):
            flat, sizes = encoder.encode(Chunk([t or "" for t in texts], "byte", specials))
            rows, done = [], 0
            for doc, n in zip(ids, sizes.tolist(), strict=True):
                own = np.append(flat[done:done + n], np.uint32(end_id)).astype("<u4")
                done += n
                first = len(own) % capacity or capacity
                edges = [0, *range(first, len(own) + 1, capacity)]
                rows += [(doc, k, a, own[a:b]) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
            out = [pa.array([r[0]["id"] if group_col else r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                   pa.array([r[2] for r in rows], pa.int64()), pa.array([len(r[3]) for r in rows], pa.int64()),
                   pa.array([zlib.crc32(r[3].tobytes()) for r in rows], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out.append(pa.array([r[3].astype(np.int32) for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            if group_col:
                out.append(pa.array([r[0]["group"] for r in rows], pa.string()))
                names.append(group_col)
            yield pa.RecordBatch.from_arrays(out, names)

    own = F.col(id_col).cast("long").alias("id")
    if group_col:
        own = F.struct(own, F.col(group_col).cast("string").alias("group")).alias("id")
    rows = docs.select(own, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if keep_ids else "") + (f", `{group_col}` string" if group_col else ""))


def fullest(space: int, counts: dict[int, int]) -> list[int]:
    """The lengths of a fullest combination of at most ``space``, each used at most as often as it is there.

    Bit ``s`` of a bitset says whether some combination sums to ``s``. Lengths
    are added from the longest on, a count in powers of two, and the search
    ends when ``space`` itself is reached; going back through the bitsets
    gives the combination.
    """
    full = (1 << (space + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x, c in counts.items() if c and x <= space), reverse=True):
        left, times = min(counts[length], space // length), 1
        while left and not reach >> space & 1:
            times = min(times, left)
            steps.append((reach, length, times))
            reach |= reach << (length * times) & full
            left -= times
            times *= 2
        if reach >> space & 1:
            break
    total = reach.bit_length() - 1
    out: list[int] = []
    for before, length, times in reversed(steps):
        if not before >> total & 1:
            out += [length] * times
            total -= length * times
    return out


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Minimum bin slack on a histogram: (number of equal bins, the lengths in each)."""
    left, plan = {k: v for k, v in counts.items() if v}, []
    while left:
        seed = max(left)
        rest = {**left, seed: left[seed] - 1}
        lengths = [seed, *fullest(capacity - seed, rest)]
        uses: dict[int, int] = {}
        for x in lengths:
            uses[x] = uses.get(x, 0) + 1
        times = min(left[x] // n for x, n in uses.items())
        plan.append((times, sorted(lengths, reverse=True)))
        for x, n in uses.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return plan


def plan_places(plan: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, uses a bin, first bin, offset of the first use) of each length in each entry."""
    out, given, bins = [], {}, 0
    for times, lengths in plan:
        at = 0
        for x in dict.fromkeys(lengths):
            n = lengths.count(x)
            low = given.get(x, 0)
            out.append((x, low, low + n * times, n, bins, at))
            given[x] = low + n * times
            at += n * x
        bins += times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_col: str | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have ``doc_id, piece, length`` (1 to ``capacity``)."""
    spark = pieces.sparkSession
    held = shared_table(pieces, "pieces")
    group = F.col(group_col) if group_col else F.lit(None).cast("string")
    histograms: dict[str | None, dict[int, int]] = {}  # at most ``capacity`` rows a group
    for r in held.groupBy(group.alias("group"), "length").agg(F.count(F.lit(1)).alias("n")).collect():
        histograms.setdefault(r["group"], {})[r["length"]] = r["n"]
    planned, bins = [], 0
    for own in sorted(histograms, key=lambda g: (g is not None, g)):
        plan = plan_bins(histograms[own], capacity)
        planned += [(own, x, low, high, uses, bins + first, at) for x, low, high, uses, first, at in plan_places(plan)]
        bins += sum(times for times, _ in plan)
    places = spark.createDataFrame(planned or [(None, 0, 0, 0, 1, 0, 0)],
                                   "group string, length long, low long, high long, uses long, first_bin long, first_offset long")
    buckets = max(LEAST_BUCKETS, sum(n for h in histograms.values() for n in h.values()) // BUCKET_ROWS)
    put = held.withColumn("_group", group).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)))
    counts = put.groupBy("_group", "length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_group", "length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_group").alias("_of"), F.col("length").alias("_length"), F.col("bucket").alias("_bucket"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("_group", "length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = put.withColumn("own", F.row_number().over(own) - 1).join(
        counts, F.col("_group").eqNullSafe(F.col("_of")) & (F.col("length") == F.col("_length")) & (F.col("bucket") == F.col("_bucket")))
    ranked = ranked.withColumn("rank", F.col("base") + F.col("own"))
    p = F.broadcast(places).alias("p")  # bounded by the capacity: see the module text
    r = ranked.alias("r")
    found = r.join(p, F.col("r._group").eqNullSafe(F.col("p.group")) & (F.col("r.length") == F.col("p.length"))
                   & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    at = F.col("rank") - F.col("low")
    return found.select(*[F.col(f"r.`{c}`") for c in pieces.columns],
                        (F.col("first_bin") + F.floor(at / F.col("uses"))).cast("long").alias("sequence_id"),
                        (F.col("first_offset") + F.pmod(at, F.col("uses")) * F.col("r.length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
                   text_col: str = "text", keep_ids: bool = False, group_col: str | None = None) -> DataFrame:
    return pack(cut_pieces(docs, path, capacity, end_id, id_col, text_col, keep_ids, group_col), capacity, group_col)


def default_path() -> str:
    return tokenizer_path(BYTE_TOKENIZER)
