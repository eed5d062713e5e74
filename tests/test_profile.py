from pyspark.sql import functions as F

from veritable.operators import domain as U
from veritable.operators import kpis as K
from veritable.operators import profile as P


def test_role_cases(spark):
    n = 40
    rows = []
    months = ["January", "February", "March", "April"]
    for i in range(n):
        rows.append((i, float(i * 3 % 17) + 0.5, "north" if i % 2 else "south", "x", i % 2, "yes" if i % 3 else "no",
                     f"2024-01-{i % 28 + 1:02d}", months[i % 4], str(1000 + i), f"note {i} " * 5))
    df = spark.createDataFrame(rows, "order_id long, amount double, region string, constant string, flag int, "
                                     "answer string, order_date string, month_name string, code_text string, comment string")
    roles = P.roles_dict(P.profile_dataset(df))
    assert roles["order_id"] == "identifier"
    assert roles["amount"] == "measure"
    assert roles["region"] == "category"
    assert roles["constant"] == "constant"
    assert roles["flag"] == "boolean"
    assert roles["answer"] == "boolean"
    assert roles["order_date"] == "datetime"
    assert roles["month_name"] == "category"
    assert roles["comment"] == "text"


def test_numeric_stats_and_notes(spark):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in [1, 2, 2, 3, 100, -1, None]], "balance double")
    s = P.numeric_stats(df, ["balance"]).first()
    assert s["n"] == 6 and s["median"] == 2.0 and s["negatives"] == 1 and s["zeros"] == 0
    prof = P.profile_dataset(df, {"balance": "measure"})
    notes = P.column_notes(prof, P.numeric_stats(df, ["balance"])).first()["notes"]
    assert "partly_empty" in notes and "negatives" not in notes      # a balance may be negative


def test_few_valued_columns(spark):
    i = F.col("id")
    df = spark.range(20_000).select(*[(i % k).alias(f"v{k}") for k in (1, 2, 14, 15, 16, 26, 300, 9_000)],
                                    F.when(i % 3 > 0, i % 15).cast("string").alias("t15"), F.lit(None).cast("string").alias("none"))
    few = P.few_valued(df, 15)
    assert {"v1", "v2", "v14", "v15", "v16", "t15", "none"} <= set(few) and not {"v300", "v9000"} & set(few)
    counts = {r.column_name: (r.unique_count, r.n_rows, r.kind) for r in P.level_counts(df, few).collect()}
    assert counts["v15"] == (15, 20_000, "numeric") and counts["t15"] == (10, 20_000, "text") and counts["none"][0] == 0
    facts = {r.column_name: (r.unique_count, r.n_rows, r.kind) for r in P.column_facts(df, few).collect()}
    assert counts == facts
    assert P.few_valued(df.select(F.array("v1").alias("a")), 15) == []


def test_lead_facts_and_chosen_kpis(spark):
    df = spark.createDataFrame([(5.0, "z", "a"), (9.0, "m", "b"), (9.0, "k", "c"), (None, "a", "d"), (1.0, "q", "e")], "v double, place string, who string")
    assert U.lead_facts(df, "v", "place").first().largest_place == "k"  # of equal ones the first by place
    cols = K.KpiColumns(revenue="v", entity="who")
    every = {r.kpi_id: r.value for r in K.all_kpis(df, cols).collect()}
    one = next(k for k in every if k not in K.ENTITY_KPIS | K.MONTHLY_KPIS)
    assert {r.kpi_id: r.value for r in K.all_kpis(df, cols, [one]).collect()} == {one: every[one]}
    assert K.all_kpis(df, cols, ["growth_rate"]).collect() == []


def test_flavour_aggregation_and_family(spark):
    assert [P.measure_flavour(n) for n in ("total_price", "qty", "height")] == ["money", "quantity", "value"]
    families = spark.createDataFrame([("sales", "business"), ("trees", "nature")], "table_name string, family string")
    roles = spark.createDataFrame([("sales", "revenue", "measure"), ("sales", "unit_price", "measure"), ("sales", "region", "category"), ("trees", "revenue", "measure")],
                                  "table_name string, column_name string, role string")
    got = {(r.table_name, r.column_name): r.aggregation for r in U.measure_aggregation(None, families, roles).collect()}
    assert got[("sales", "revenue")] == "sum" and got[("trees", "revenue")] == "mean" and ("sales", "region") not in got
    texts = spark.createDataFrame([(1, "Orders, customers and revenue of the shop"), (2, "nothing at all"), (3, None)], "description_id int, text string")
    got = {r.description_id: r.family for r in U.family_from_text(texts, "text").collect()}
    assert got[1] == "business" and got[2] == "general" and got[3] == "general"
