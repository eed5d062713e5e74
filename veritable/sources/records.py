"""Delimited text with quoted line breaks, read by many tasks a file.

A line break inside quotes does not end a record, so a task that begins in the
middle of a file cannot know whether its first line is inside a field. It can
know both answers: for each block of a file, a scan follows the lines from
either start (outside or inside quotes) and notes where the block ends and how
many records begin in it. These are two rows' worth of numbers a block. Going
through a file's blocks in order then gives each block's true start, and the
number of the records before it.

If no line of any file ends inside quotes, lines are records and Spark's own
splittable reader does the rest. Otherwise a second scan cuts each block into
whole records; the pieces of a record that goes over a block's edge are put
together by the block it began in. Records are parsed by ``from_csv``.

What is sent to all tasks is a few numbers for each block that begins inside
quotes or among a file's first records: some 40 bytes for a block of up to
``spark.sql.files.maxPartitionBytes``.

A field is quoted if a quote is its first character; two quotes inside are one;
what follows the closing quote belongs to the field up to the next delimiter.
Lines end with LF or CR LF; in a record that ends with CR LF the breaks inside
quotes become LF, as Spark's whole-file reader gives them. Blank lines between
records are none. Text is UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritable.session import ship_package

BLOCK = ["file", "start"]


def ends_inside(line: str, sep: str, inside: bool) -> bool:
    """Whether a line ends inside quotes, given how it begins; a line that begins outside begins a field."""
    at, size = 0, len(line)
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(sep, at)
                if at < 0:
                    return False
                at += len(sep)
                continue
            at += 1
        while True:  # the closing quote
            at = line.find('"', at)
            if at < 0:
                return True
            if not line.startswith('"', at + 1):
                break
            at += 2
        at = line.find(sep, at + 1, size)
        if at < 0:
            return False
        at, inside = at + len(sep), False


class Scan:
    """A block's way through its lines from one start: the end, the records begun, the widest record, lines left open."""

    def __init__(self, sep: str, inside: bool):
        self.sep, self.inside, self.records, self.open_lines = sep, inside, 0, 0
        self.width = self.most = 0

    def take(self, line: str, bare: bool, marks: int) -> None:
        if not self.inside:
            if not line or line == "\r":
                return
            self.records += 1
            self.width = 1
        self.width += marks
        self.most = max(self.most, self.width)
        if not bare:
            self.inside = ends_inside(line, self.sep, self.inside)
        self.open_lines += self.inside


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value) of every line, in the order of the file within a block."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list]]:
    """(file, start, lines): stretches of one block; a block may come in several, one after the other.

    A file's byte order mark is left out.
    """
    last = None
    for batch in batches:
        files, starts = batch.column("file").to_pylist(), batch.column("start").to_pylist()
        lines, done = batch.column("value").to_pylist(), 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or starts[i] != starts[done] or files[i] != files[done]:
                if starts[done] == 0 and last != files[done]:
                    lines[done] = lines[done].removeprefix("\ufeff")
                yield files[done], starts[done], lines[done:i]
                last, done = files[done], i


def scan_blocks(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """A row a block: for a start outside (0) and inside (1) quotes its end, records, widest record and open lines."""
    ship_package(spark)
    names = ["ends", "records", "width", "open_lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ways = None, []

        def row() -> pa.RecordBatch:
            values = [[int(w.inside), w.records, w.most, w.open_lines] for w in ways]
            return pa.RecordBatch.from_arrays(
                [pa.array([last[0]]), pa.array([last[1]], pa.int64()), *[pa.array([v[k]], pa.int64()) for k in range(4) for v in values]],
                BLOCK + [f"{n}{s}" for n in names for s in (0, 1)])

        for file, start, lines in _runs(batches):
            if last != (file, start):
                if last:
                    yield row()
                last, ways = (file, start), [Scan(sep, False), Scan(sep, True)]
            for line in lines:
                bare, marks = '"' not in line, line.count(sep)
                for w in ways:
                    w.take(line, bare, marks)
        if last:
            yield row()

    schema = "file string, start long, " + ", ".join(f"{n}{s} long" for n in names for s in (0, 1))
    return _lines(spark, path).mapInArrow(run, schema)


def true_starts(blocks: DataFrame) -> DataFrame:
    """(file, start, inside, origin, before, records, width, open_lines): how each block really begins.

    ``origin``: the block in which the record began that is open there;
    ``before``: records begun in the file before the block.
    """

    def run(group: pa.Table) -> pa.Table:
        rows, out = sorted(group.to_pylist(), key=lambda r: r["start"]), []
        inside, origin, before = 0, None, 0
        for r in rows:
            began = r[f"records{inside}"]
            out.append((r["file"], r["start"], bool(inside), origin if inside else None, before, began, r[f"width{inside}"], r[f"open_lines{inside}"]))
            before += began
            inside = r[f"ends{inside}"]
            origin = r["start"] if began and inside else origin
        kinds = [pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 5]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                        ["file", "start", "inside", "origin", "before", "records", "width", "open_lines"])

    schema = "file string, start long, inside boolean, origin long, before long, records long, width long, open_lines long"
    return blocks.groupBy("file").applyInArrow(run, schema)


def cut_records(spark: SparkSession, path: str, sep: str, starts: dict[tuple[str, int], tuple[bool, int | None, int]], numbered: int) -> DataFrame:
    """(file, number, record): every record; ``number`` counts a file's records from 0, for the first ``numbered`` ones at least.

    ``starts``: (inside, origin, records before) of the blocks that begin
    inside quotes or have fewer than ``numbered`` records before them.
    """
    ship_package(spark)
    sent = spark.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, inside, origin, number, part = None, False, None, None, []

        def flush() -> pa.RecordBatch:
            columns = zip(*held, strict=True)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                              ["file", "origin", "start", "number", "whole", "record"])

        for file, start, lines in _runs(batches):
            if last != (file, start):
                if part:
                    held.append((last[0], last[1] if origin is None else origin, last[1], number, False, "\n".join(part)))
                last, part = (file, start), []
                inside, origin, before = sent.value.get(last, (False, None, None))
                number = None if before is None else before - (1 if inside else 0)
                number = 0 if start == 0 else number
                if not inside:
                    origin = None
            for line in lines:
                if not part and origin is None and not inside and (not line or line == "\r"):
                    continue
                part.append(line)
                if '"' in line:
                    inside = ends_inside(line, sep, inside)
                if not inside:
                    whole = origin is None
                    held.append((file, start if whole else origin, start, number, whole, "\n".join(part)))
                    part, origin = [], None
                    number = None if number is None or number > numbered else number + 1
                    if len(held) >= 5_000:
                        yield flush()
                        held = []
        if part:
            held.append((last[0], last[1] if origin is None else origin, last[1], number, False, "\n".join(part)))
        if held:
            yield flush()

    cut = _lines(spark, path).mapInArrow(run, "file string, origin long, start long, number long, whole boolean, record string")
    pieces = cut.where("NOT whole").groupBy("file", "origin").agg(  # the pieces of one record
        F.min_by("number", "start").alias("number"), F.sort_array(F.collect_list(F.struct("start", "record"))).alias("p"))
    joined = pieces.select("file", "number", F.array_join(F.col("p.record"), "\n").alias("record"))
    every = cut.where("whole").select("file", "number", "record").unionByName(joined)
    bare = F.replace(F.regexp_replace("record", "\r$", ""), F.lit("\r\n"), F.lit("\n"))
    return every.withColumn("record", F.when(F.endswith("record", F.lit("\r")), bare).otherwise(F.col("record")))
