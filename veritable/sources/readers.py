"""Sources, sinks and table shaping.

Delimited text is read by Spark's splittable CSV scan, or cut into records in
parallel where quoted fields hold line breaks (``sources/records.py``). The
delimiter, the records above the names and the names come from one look at the
beginning of the first file (a bounded sample by design).
"""

from __future__ import annotations

import csv
import os
import re
import uuid
import warnings
from collections import Counter
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veritable.functions.exprs import nan_to_null
from veritable.session import cut_lineage
from veritable.sources import records
from veritable.sources.records import ends_inside

# Fixed values of the loader rules.
DELIMITERS = (",", ";", "\t", "|")
BAD_HEADER_SHARE = 0.4
SNIFF_LINES = 50
TEXT_SUFFIXES = (".csv", ".tsv", ".txt")


def first_file(spark: SparkSession, path: str) -> str | None:
    """The first non-empty file of a path by name: from the listing, no file is opened."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    return files.agg(F.min("path")).first()[0]


def head_lines(spark: SparkSession, file: str, lines: int) -> list[str]:
    """The first lines of a file.

    Spark puts a file's blocks, all of one size but the last, into partitions in
    their order, and a limit reads partitions in order until it has its rows:
    usually the beginning of the first block.
    """
    text = spark.read.option("lineSep", "\n").text(file).limit(lines).collect()
    return [r[0].removeprefix("\ufeff") for r in text]


def choose_delimiter(lines: list[str]) -> str:
    """The candidate with the same non-zero number in all lines (the most
    frequent of them); else the most frequent in line one; else comma."""
    counts = [[line.count(d) for line in lines] for d in DELIMITERS]
    even = [(c[0], -i) for i, c in enumerate(counts) if c and c[0] > 0 and len(set(c)) == 1]
    first = [(c[0], -i) for i, c in enumerate(counts) if c and c[0] > 0]
    return DELIMITERS[-max(even or first)[1]] if first else ","


def sniff_delimiter(spark: SparkSession, path: str, lines: int = SNIFF_LINES) -> str:
    """S2 over the first ``lines`` lines. ``.tsv`` is always tab. Of a folder, the
    first file by name decides (files of another format are read on their own)."""
    if path.lower().endswith(".tsv"):
        return "\t"
    file = first_file(spark, path)
    return choose_delimiter([x.removesuffix("\r") for x in head_lines(spark, file, lines)]) if file else ","


def header_looks_wrong(columns: list[str]) -> bool:
    """S3: at least 40% of names blank or auto-generated placeholders (``Unnamed: 3``, ``_c3``)."""
    placeholder = re.compile(r"\s*|Unnamed:.*|_c\d+")
    bad = sum(placeholder.fullmatch(str(c)) is not None for c in columns)
    return bool(columns) and bad >= BAD_HEADER_SHARE * len(columns)


@dataclass(frozen=True)
class Head:
    """What the beginning of the first file says: delimiter, records above the names, names, usual number of fields."""

    sep: str
    skip: int
    names: tuple[str, ...]
    width: int


def read_head(spark: SparkSession, path: str, sep: str | None = None, skip: int | None = None, max_skip: int = 0) -> Head:
    """S2 and S3 in one look at the first file's beginning: its first ``SNIFF_LINES`` lines, and more if the names need them.

    ``skip`` says how many records are above the names; None: the first number
    up to ``max_skip`` at which the names look right, else 0. A record with
    fewer fields than most is filled up with blank names.
    """
    file, lines = first_file(spark, path), SNIFF_LINES
    if file is None:
        return Head(sep or ",", 0, (), 0)
    while True:
        text = head_lines(spark, file, lines)
        mark = sep or ("\t" if path.lower().endswith(".tsv") else choose_delimiter([x.removesuffix("\r") for x in text]))
        records, part, inside = [], [], False
        for line in text:
            if not part and line in ("", "\r"):
                continue
            part.append(line)
            inside = ends_inside(line, mark, inside)
            if not inside:
                records.append(next(csv.reader(["\n".join(part).removesuffix("\r")], delimiter=mark), []))
                part = []
        if len(text) < lines or len(records) > (max_skip if skip is None else skip):
            break
        lines *= 8
    widths = Counter(map(len, records))
    width = max(widths, key=lambda n: (widths[n], n), default=0)

    def names(k: int) -> tuple[str, ...]:
        own = records[k] if k < len(records) else []
        return tuple(own + [""] * (width - len(own)))

    if skip is None:
        skip = next((k for k in range(max_skip + 1) if k < len(records) and not header_looks_wrong(names(k))), 0)
    return Head(mark, skip, names(skip), width)


def safe_names(names: tuple[str, ...]) -> list[str]:
    """Blank names become ``_c<i>``, repeated ones (without case) get their place at the end, as Spark's reader has it."""
    many = {n for n, k in Counter(x.lower() for x in names).items() if k > 1}
    return [f"_c{i}" if not n else f"{n}{i}" if n.lower() in many else n for i, n in enumerate(names)]


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8",
                   header: bool = True, skip_lines: int = 0, schema: str | None = None,
                   infer_schema: bool = True, multi_line: bool = True) -> DataFrame:
    """Delimited text (CSV/TSV/TXT) as a DataFrame; NaN becomes NULL.

    ``skip_lines`` drops the first N records of every file, and the next one
    holds the names (the header repair of S3). Quoted fields may hold line
    breaks, and files are split among tasks all the same (``sources/records.py``);
    ``multi_line=False`` says that they do not, which saves a scan. Pass
    ``schema`` at scale to skip inference. Text in another encoding than UTF-8
    is read by one task a file.
    """
    sep = sep or sniff_delimiter(spark, path)
    reader = spark.read.option("sep", sep).option("encoding", encoding).option("escape", '"')
    utf8 = encoding.upper().replace("-", "") == "UTF8"
    if skip_lines <= 0 and (not multi_line or not utf8):
        reader = reader.schema(schema) if schema else reader.option("inferSchema", infer_schema)
        return nan_to_null(reader.option("header", header).option("multiLine", multi_line).csv(path))
    if not utf8:
        return nan_to_null(_below(spark, reader.option("multiLine", True), path, sep, header, skip_lines, schema, infer_schema))
    blocks = cut_lineage(records.true_starts(records.scan_blocks(spark, path, sep)))
    total = blocks.agg(F.sum("open_lines"), F.max("width")).first()
    if not total[0] and skip_lines <= 0:  # every line is a record
        reader = reader.schema(schema) if schema else reader.option("inferSchema", infer_schema)
        return nan_to_null(reader.option("header", header).csv(path))
    return nan_to_null(_parsed(spark, path, sep, header, skip_lines, schema, infer_schema, blocks, total[1] or 0))


def _parsed(spark, path: str, sep: str, header: bool, skip: int, schema: str | None, infer: bool, blocks: DataFrame, width: int) -> DataFrame:
    """The records below the names, from a scan of the path's blocks, named and typed."""
    first_row = max(0, skip) + (1 if header else 0)
    known = blocks.where(F.col("inside") | ((F.col("before") < first_row) & (F.col("start") > 0)))
    starts = {(r["file"], r["start"]): (r["inside"], r["origin"], r["before"]) for r in known.collect()}  # see sources/records.py
    cut = records.cut_records(spark, path, sep, starts, first_row)
    body = cut.where(F.col("number").isNull() | (F.col("number") >= first_row))
    options = {"sep": sep, "escape": '"', "multiLine": "true"}
    if schema:
        return body.select(F.from_csv("record", schema, options).alias("r")).select("r.*")
    head = read_head(spark, path, sep, max(0, skip))
    titles = safe_names(head.names) if header else [f"_c{i}" for i in range(max(width, head.width))]
    if not titles:
        return spark.createDataFrame([], "struct<>")
    names = [f"_f{i}" for i in range(len(titles))]
    body = body.select(F.from_csv("record", ", ".join(f"{n} string" for n in names), options).alias("r")).select("r.*")
    if infer:
        body, used = _typed(body, names)
        if not header:  # the scan's width also counts delimiters inside quotes
            last = max([head.width - 1, *(i for i, n in enumerate(names) if used[n])])
            body, titles = body.select(*names[:last + 1]), titles[:last + 1]
    return body.toDF(*titles)


#: Types that text columns are tried for, in this order, and patterns that narrow Spark's casts to what a reader takes.
KINDS = {"int": None, "bigint": None, "double": None, "date": r"^\d{4}-\d{2}-\d{2}$", "timestamp": None, "boolean": "(?i)^(true|false)$"}


def _typed(body: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """Text columns cast to the first type that all their values have, and the number of values of each."""

    def value(n: str, kind: str):
        cast = F.col(n).try_cast(kind)
        return F.when(F.col(n).rlike(KINDS[kind]), cast) if KINDS[kind] else cast

    fits = body.agg(*[F.count(F.col(n)).alias(f"{n}_n") for n in names],
                    *[F.count(value(n, k)).alias(f"{n}_{k}") for n in names for k in KINDS]).first()
    used = {n: fits[f"{n}_n"] for n in names}
    kind_of = {n: next((k for k in KINDS if 0 < used[n] == fits[f"{n}_{k}"]), "string") for n in names}
    return body.select(*[F.col(n).try_cast(kind_of[n]).alias(n) for n in names]), used


def _below(spark, reader, path: str, sep: str, header: bool, skip: int, schema: str | None, infer: bool) -> DataFrame:
    """As ``_parsed`` for text that is not UTF-8: whole files under positional names, records numbered where they are read.

    Ids grow in file order, and a file's first block starts at its smallest id.
    """
    head = read_head(spark, path, sep, skip)
    names = [f"_f{i}" for i in range(head.width)]
    every = reader.option("header", False).schema(", ".join(f"{n} string" for n in names)).csv(path)
    every = every.select(*names, F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    starts = every.groupBy("_file").agg(F.min("_at").alias("_start"))
    placed = every.join(starts, "_file").withColumn("_n", F.col("_at") - F.col("_start"))
    titles, first_row = [f"_c{i}" for i in range(len(names))], skip
    if header:
        row = placed.where(F.col("_n") == skip).orderBy("_file").select(*names).first()
        titles, first_row = safe_names(tuple(x or "" for x in row or [""] * len(names))), skip + 1
    body = placed.where(F.col("_n") >= first_row).select(*names)
    if schema:
        wanted = spark.createDataFrame([], schema).schema.fields
        return body.select(*[F.col(names[i]).try_cast(f.dataType).alias(f.name) for i, f in enumerate(wanted)])
    return (_typed(body, names)[0] if infer else body).toDF(*titles)


def read_table(spark: SparkSession, path: str, max_skip: int = 5, **options) -> DataFrame:
    """S1 dispatch by suffix (of a folder without one, that of its first file): parquet, orc, json, or delimited text;
    titles above the names (up to ``max_skip``) are skipped."""
    low = path.lower().rstrip("/")
    if "." not in low.rsplit("/", 1)[-1]:
        low = (first_file(spark, path) or low).lower()
    for suffix in ("parquet", "orc", "json"):
        if low.endswith(f".{suffix}"):
            return nan_to_null(spark.read.format(suffix).load(path))
    if "skip_lines" not in options and options.get("header", True):
        head = read_head(spark, path, options.get("sep"), max_skip=max_skip)
        options |= {"sep": head.sep, "skip_lines": head.skip}
    return read_delimited(spark, path, **options)


def tidy(df: DataFrame) -> DataFrame:
    """Drop all-null rows and columns, name blank columns ``column_<i>``
    and make repeated names unique with ``_1``, ``_2``. One aggregate finds the
    empty columns."""
    original = list(df.columns)
    df = df.toDF(*[f"_p{i}" for i in range(len(original))]).na.drop(how="all")  # positional names: duplicates are legal
    counts = df.agg(*[F.count(F.col(f"_p{i}")).alias(f"n{i}") for i in range(len(original))]).first()
    keep = [i for i in range(len(original)) if counts is not None and counts[f"n{i}"] > 0]
    names, seen = [], {}
    for i in keep:
        name = str(original[i]).strip() or f"column_{i + 1}"
        if name in seen:
            seen[name] += 1
            name = f"{name}_{seen[name]}"
        else:
            seen[name] = 0
        names.append(name)
    return df.select(*[F.col(f"_p{i}").alias(n) for i, n in zip(keep, names)])


def load_many(spark: SparkSession, paths: list[str], **options) -> dict[str, DataFrame]:
    """Read every file, skipping unreadable ones with a warning."""
    out = {}
    for p in paths:
        try:
            out[os.path.splitext(os.path.basename(p.rstrip("/")))[0]] = tidy(read_table(spark, p, **options))
        except (PySparkException, OSError, ValueError) as exc:  # an unreadable file is skipped, as documented
            warnings.warn(f"skipped {p}: {exc}")
    return out


def attach_all(tables: dict[str, DataFrame], roles: dict[str, dict[str, str]]) -> tuple[DataFrame, list[dict]]:
    """One table of several: the base (J5) with every lookup attached by its best safe join.

    Returns the table and one report row a lookup: the columns joined on and
    the rows before and after, or no columns where no join was safe.
    """
    from veritable.operators import joining as J

    base = J.choose_base(tables, roles)
    out, report, known = tables[base], [], dict(roles.get(base, {}))
    for name in (n for n in tables if n != base):
        lookup, theirs = tables[name], roles.get(name, {})
        found = J.find_candidates(out, lookup, known, theirs, J.distinct_counts(out, J.key_names(out, known)),
                                  J.distinct_counts(lookup, J.key_names(lookup, theirs))).where("safe").first()
        row = {"lookup": name, "left_column": None, "right_column": None}
        if found is not None:
            row |= {"left_column": found["left_column"], "right_column": found["right_column"],
                    "rows_before": found["left_rows"], "rows_after": found["expected_rows"]}
            out = J.apply_join(out, lookup, found["left_column"], found["right_column"])
            known |= {c: r for c, r in theirs.items() if c in out.columns and c not in known}
        report.append(row)
    return out, report


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write the cleaned table (parquet by default, CSV with a header).

    An overwrite is staged: the rows go to a folder beside ``path`` and take
    its place by renaming once all are written. A job that fails leaves the old
    table, and a table may be read and overwritten in one go. Dying between the
    two renames leaves the old table as ``<path>.veritable-before``; the next overwrite
    puts it back first.
    """
    def write(to: str, how: str) -> None:
        writer = df.write.mode(how)
        if fmt == "csv":
            writer.option("header", True).option("escape", '"').csv(to)  # quotes doubled, as the readers take them
        else:
            writer.format(fmt).save(to)

    if mode != "overwrite":
        write(path, mode)
        return
    spark, path = df.sparkSession, path.rstrip("/")
    at = spark._jvm.org.apache.hadoop.fs.Path
    own, before, staged = at(path), at(f"{path}.veritable-before"), at(f"{path}.staged-{uuid.uuid4().hex[:12]}")
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(before) and not fs.exists(own):
        _renamed(fs, before, own)
    try:
        write(staged.toString(), "errorifexists")
    except BaseException:
        fs.delete(staged, True)
        raise
    if fs.exists(own):
        fs.delete(before, True)
        _renamed(fs, own, before)
    _renamed(fs, staged, own)
    fs.delete(before, True)


def _renamed(fs, old, new) -> None:
    if not fs.rename(old, new):
        raise OSError(f"{old.toString()} can't be renamed to {new.toString()}")


@dataclass
class OperationLog:
    """One row per transformation: step, note, rows/columns before and after.

    Each step's row count rides on the next action through
    ``DataFrame.observe``, so the log adds no extra pass over the data; the
    rows before a step are the rows after the previous one.
    """

    entries: list = field(default_factory=list)

    def track(self, step: str, after: DataFrame, columns_before: int, note: str = "") -> DataFrame:
        obs = Observation(f"op_{len(self.entries)}")
        observed = after.observe(obs, F.count(F.lit(1)).alias("rows"))
        self.entries.append((step, note, obs, columns_before, len(after.columns)))
        return observed

    def table(self, spark: SparkSession, rows_at_start: int | None = None) -> DataFrame:
        rows, previous = [], rows_at_start
        for step, note, obs, cb, ca in self.entries:
            after = obs.get.get("rows") if obs.get else None
            rows.append((step, note, previous, after, cb, ca))
            previous = after
        return spark.createDataFrame(rows, "step string, note string, rows_before bigint, rows_after bigint, "
                                           "columns_before int, columns_after int")


def digest(df: DataFrame, profile: DataFrame, rows: int = 5) -> str:
    """Shape, per-column facts and the first rows as CSV text (bounded)."""
    prof = profile.select("column_name", "role", "missing_rate").collect()  # one row per column
    lines = [f"{len(prof)} columns", "", "Columns:"]
    lines += [f"- {r['column_name']} ({r['role']}), {r['missing_rate']:.0%} empty" for r in prof]
    head = df.limit(rows).toPandas()
    lines += ["", f"First {rows} rows:", head.to_csv(index=False).strip()]
    return "\n".join(lines)
