from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from veritable.plans.axes import available_axes, build_charts, fill_slots
from veritable.plans.pipeline import Options, Pipeline, chart_findings
from veritable.sources.tables import load


def test_pipeline_runs_every_stage_on_orders(spark):
    orders = load(spark, SF_SMALL, "orders")
    customer = load(spark, SF_SMALL, "customer").select("c_custkey", "c_mktsegment")
    df = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").drop("c_custkey")
    roles = {"o_orderkey": "identifier", "o_custkey": "identifier"}
    res = Pipeline(Options(roles=roles)).run(df)
    assert res.cleaned.count() == df.count()
    assert "year" in res.cleaned.columns and "revenue_tier" in res.cleaned.columns
    ids = {r["kpi_id"] for r in res.kpis.collect()}
    assert {"record_count", "total_revenue", "growth_rate"} <= ids
    assert res.charts and res.findings.count() == len(res.charts)
    for cid, (_axis, _kind, table) in res.charts.items():
        table.limit(1).collect()      # every chart table plans and runs
    cmp = Pipeline(Options()).verify_bar(res.cleaned, "o_orderpriority", "o_totalprice").first()
    assert cmp["verdict"] in ("noise", "weak", "solid", "too_few")


PROFILE = [{"column_name": "revenue", "role": "measure", "unique_count": 100, "missing_count": 0},
           {"column_name": "order_date", "role": "datetime", "unique_count": 50, "missing_count": 0},
           {"column_name": "region", "role": "category", "unique_count": 5, "missing_count": 3},
           {"column_name": "product", "role": "category", "unique_count": 4, "missing_count": 0},
           {"column_name": "year", "role": "measure", "unique_count": 4, "missing_count": 0}]


def test_axes_follow_columns():
    slots = fill_slots(PROFILE, ["revenue", "order_date", "region"])
    assert slots["measure"] == "revenue" and slots["date"] == "order_date" and slots.pools["measure"] == ["revenue"]
    assert available_axes(slots) == ["sales", "regions"]
    assert available_axes(fill_slots(PROFILE, ["region"])) == ["regions"]
    assert available_axes(fill_slots([], [])) == ["sales"]
    plain = fill_slots(PROFILE, ["revenue", "order_date", "region"], business=False)
    assert available_axes(plain) == ["time", "comparisons", "locations", "distributions", "quality"]
    assert available_axes(fill_slots([], [], business=False)) == ["quality"]
    assert fill_slots(PROFILE, ["revenue", "region", "product"], preferred={"main_category": "product"})["main_category"] == "product"


def test_charts_and_findings_of_the_axes(spark):
    df = spark.createDataFrame([(float(i % 7 + 1), f"2024-{i % 6 + 1:02d}-03", f"r{i % 3}", f"p{i % 2}") for i in range(120)],
                               "revenue double, order_date string, region string, product string")
    df = df.withColumn("order_date", F.to_date("order_date"))
    slots = fill_slots(PROFILE, df.columns)
    charts = build_charts(df, slots, ["regions", "products", "quality"])
    assert [c for c, (axis, _, _) in charts.items() if axis == "regions"] == [
        "bar_region_revenue_sum", "box_region_revenue", "pivot_region_product_revenue"]
    assert charts["trend_order_date_revenue_sum"][0] == "general"          # regions would draw the same one
    rows = {r["finding_id"]: r for r in chart_findings(spark, charts).collect()}
    assert set(rows) == set(charts)
    assert rows["bar_region_revenue_sum"]["confidence"] == "high" and rows["bar_region_revenue_sum"]["evidence_rows"] == 3
    assert '"top_label"' in rows["bar_region_revenue_sum"]["facts"]
    last = max(rows.values(), key=lambda r: r["position"])
    assert last["axis"] == "general"
    assert {r["confidence"] for r in chart_findings(spark, charts, business=False).collect()} == {"medium"}
