import os

from pyspark.sql import functions as F

import __spark_entry__ as entry
from veritable.operators import compare as V
from veritable.sources import readers as R


def test_sniff_and_header_repair(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "sales.csv")
    with open(path, "w") as fh:
        fh.write("Monthly export;;\n")
        fh.write("order_id;region;revenue\n")
        fh.write("1;north;10.5\n2;south;7\n3;north;1.25\n")
    assert R.sniff_delimiter(spark, path) == ";"
    df = R.read_table(spark, path)
    assert df.columns == ["order_id", "region", "revenue"]
    assert df.agg(F.sum("revenue")).first()[0] == 18.75


def test_header_repair_keeps_quoted_line_breaks_and_files_apart(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "out.csv")
    os.makedirs(folder)
    for k in range(2):
        with open(os.path.join(folder, f"part-{k}.csv"), "w") as fh:
            fh.write("Report\n\"for\nall\"\norder_id,note,amount,day\n")
            fh.write(f'{k}1,"two\nlines, ""quoted""",2.5,2024-01-0{k + 1}\n{k}2,plain,3,2024-02-01\n')
    df = R.read_delimited(spark, folder, sep=",", skip_lines=2)
    assert df.columns == ["order_id", "note", "amount", "day"]
    rows = {r["order_id"]: r for r in df.collect()}
    assert set(rows) == {1, 2, 11, 12} and rows[11]["note"] == 'two\nlines, "quoted"' and rows[2]["amount"] == 3.0
    assert df.agg(F.count("day")).first()[0] == 4


def test_placeholder_names():
    assert not R.header_looks_wrong(["_class", "_count", "x"])
    assert R.header_looks_wrong(["Title", "_c1", "Unnamed: 2"]) and not R.header_looks_wrong([])


def test_attach_all(spark):
    orders = spark.createDataFrame([(i, i % 8, float(i)) for i in range(60)], "order_id long, customer long, amount double")
    people = spark.createDataFrame([(float(i), f"n{i}") for i in range(8)], "customer double, name string")
    other = spark.createDataFrame([(f"z{i}", i) for i in range(9)], "code string, rank long")
    roles = {"orders": {"order_id": "identifier", "customer": "identifier", "amount": "measure"},
             "people": {"customer": "identifier", "name": "category"}, "other": {"code": "category", "rank": "measure"}}
    out, report = R.attach_all({"people": people, "orders": orders, "other": other}, roles)
    assert out.columns == ["order_id", "customer", "amount", "name"] and out.count() == 60
    assert out.where("name IS NULL").count() == 0
    assert {r["lookup"]: r["left_column"] for r in report} == {"people": "customer", "other": None}


def test_tsv_is_tab(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "t.tsv")
    with open(path, "w") as fh:
        fh.write("a\tb\n1\t2\n")
    assert R.sniff_delimiter(spark, path) == "\t"


def test_fingerprint_is_order_and_case_free():
    assert V.fingerprint([" B", "a"]) == V.fingerprint(["A", "b "])
    assert len(V.fingerprint(["x"])) == 16


def test_run_store_previous(spark, tmpdir_path):
    store = V.RunStore(spark, os.path.join(tmpdir_path, "runs"))
    k = spark.createDataFrame([("total_revenue", 10.0, "money")], "kpi_id string, value double, unit string")
    store.append("r1", "2024-01-01T00:00:00", "fp", 3.0, k)
    store.append("r2", "2024-02-01T00:00:00", "fp", 3.0, k)
    store.append("r3", "2024-03-01T00:00:00", "other", 3.0, k)
    assert store.previous("fp", "r3").first()["run_id"] == "r2"


def test_entry_contract(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100
