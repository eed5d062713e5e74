"""Delimited text cut into records by many tasks, against Python's own parser and Spark's whole-file reader."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from veritable.sources import readers as R
from veritable.sources import records


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return path


def value(rng):
    return rng.choice(["plain", "two\nlines", 'say "hi"', "a,b", "", "é\n\n\nü,\"\"\n", '"', "\n", "x" * rng.randint(0, 90), '5" pipe', "end\n", "1,\"2\n3\",4"])


@pytest.fixture()
def small_blocks(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "1"))
    for k, v in held.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("block", [37, 200, 5_000])
def test_records_at_any_block_edge(spark, tmpdir_path, small_blocks, block):
    rng = random.Random(block)
    rows = [[str(i), value(rng), value(rng)] for i in range(150)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["id", "first", "second"], *rows])
    path = write(tmpdir_path, "quoted.csv", out.getvalue())
    small_blocks(block)
    blocks = records.true_starts(records.scan_blocks(spark, path, ",")).collect()
    assert block > 2_000 or len(blocks) > 5 and any(b.inside for b in blocks)
    df = R.read_delimited(spark, path)
    assert df.columns == ["id", "first", "second"]
    got = {str(r.id): (r.first or "", r.second or "") for r in df.collect()}
    assert got == {i: (a, b) for i, a, b in rows}


def test_same_rows_as_the_whole_file_reader(spark, tmpdir_path, small_blocks):
    text = 'id;note;amount\r\n1;"a\r\nb ""c"";d";2.5\r\n2;5" pipe;3\r\n\r\n3;"";\r\n4;"x"y;7\r\n5;"open ""\r\n;\r\n"" still";8\r\n6;last;9\r\n'
    folder = os.path.join(tmpdir_path, "in.csv")
    for k in range(3):
        write(folder, f"part-{k}.csv", text)
    whole = spark.read.options(sep=";", escape='"', multiLine=True, header=True, inferSchema=True).csv(folder)
    small_blocks(40)
    got = R.read_delimited(spark, folder)
    assert got.schema == whole.schema
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    typed = R.read_delimited(spark, folder, schema="a long, b string, c double")
    assert typed.columns == ["a", "b", "c"] and typed.agg(F.sum("c")).first()[0] == 3 * 29.5


def test_a_field_longer_than_blocks(spark, tmpdir_path, small_blocks):
    long = "\n".join(f"line {i}, \"\"x\"\"" for i in range(400))
    path = write(tmpdir_path, "long.csv", f'a,b\n1,"{long}"\n2,"{long}"\n3,z\n')
    small_blocks(500)
    got = {r.a: r.b for r in R.read_delimited(spark, path).collect()}
    assert got == {1: long.replace('""', '"'), 2: long.replace('""', '"'), 3: "z"}


@pytest.mark.parametrize("block", [30, 10_000])
def test_skip_and_no_header(spark, tmpdir_path, small_blocks, block):
    folder = os.path.join(tmpdir_path, "skip.csv")
    for k in range(3):
        write(folder, f"{k}.csv", f'"Report\nof, all",,\nmade today,,\nid,text,n\n{k}1,"x\ny",1\n{k}2,z,2\n')
    small_blocks(block)
    df = R.read_table(spark, folder)
    assert df.columns == ["id", "text", "n"]
    assert sorted((r.id, r.text, r.n) for r in df.collect()) == sorted((int(f"{k}{j}"), t, j) for k in range(3) for j, t in ((1, "x\ny"), (2, "z")))
    wide = write(tmpdir_path, "wide.csv", "\n".join(["a,b"] * 80 + ['1,2,3,"4,\n4",5']) + "\n")
    got = R.read_delimited(spark, wide, sep=",", header=False)
    assert got.columns == [f"_c{i}" for i in range(5)] and got.count() == 81  # a field beyond the usual width stays
    assert [r._c3 for r in got.where("_c3 IS NOT NULL").collect()] == ["4,\n4"]


def test_line_ends():
    for line, inside, want in [("a,b", False, False), ('a,"b', False, True), ('a,"b""', False, True), ('"a""b",c', False, False), ('5" pipe,x', False, False),
                               ('still" ,"open', True, True), ('x""y', True, True), ('x",y', True, False), ('"a"b"c,d', False, False), ("", True, True), ('"', False, True),
                               ('""', False, False), ('"",""', False, False), ('a,""""', False, False), ('a,"""', False, True)]:
        assert records.ends_inside(line, ",", inside) is want, (line, inside)


def test_head_is_read_once(spark, tmpdir_path):
    """The head comes from the first file by name; a header that needs more than the first lines gets them."""
    folder = os.path.join(tmpdir_path, "h.csv")
    write(folder, "a.csv", "")
    title = "\n".join(f"remark {i}; with; marks" for i in range(70))
    write(folder, "b.csv", f'"{title}";;\nid;x;y\n1;2;3\n')
    write(folder, "c.csv", "never|looked|at\n")
    head = R.read_head(spark, folder, max_skip=3)
    assert (head.sep, head.skip, head.names, head.width) == (";", 1, ("id", "x", "y"), 3)
    assert R.read_head(spark, write(tmpdir_path, "e.csv", "")).names == ()
    assert R.choose_delimiter(["a,b;c;d", "a;b;c,,,", "x;y;z"]) == ";" and R.choose_delimiter(["a|b|c,d", "x"]) == "|" and R.choose_delimiter([]) == ","


def test_other_encoding(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "latin.csv")
    with open(path, "w", encoding="latin-1") as f:
        f.write('Title,\nname,n\n"é\nü",1\n')
    df = R.read_table(spark, path, encoding="iso-8859-1")
    assert df.columns == ["name", "n"] and df.collect()[0] == ("é\nü", 1)


def test_byte_order_mark_and_names(spark, tmpdir_path):
    path = write(tmpdir_path, "bom.csv", '\ufeff"a\nb",x,X,\n1,"2\n",3,4\n')
    assert R.read_delimited(spark, path).columns == ["a\nb", "x1", "X2", "_c3"]
    assert R.read_delimited(spark, path, header=False).first()[0] == "a\nb"
