import os

from veritable.operators import claims as M
from veritable.operators import kpis as K
from veritable.streaming import monitor_claims


def test_monitor_runs_batch_checks_per_micro_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    df = spark.createDataFrame([(float(i), "Cancelled" if i % 5 == 0 else "Done") for i in range(1, 51)],
                               "revenue double, status string")
    df.write.parquet(src)
    q = monitor_claims(spark, src, df.schema, [M.Claim("exclusion", "status", values=["cancelled"], claim_id="x")],
                       K.KpiColumns(revenue="revenue"), os.path.join(tmpdir_path, "out"),
                       os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination(120)
    claims = spark.read.parquet(os.path.join(tmpdir_path, "out", "claims")).collect()
    assert claims[0]["claim_id"] == "x" and not claims[0]["holds"] and claims[0]["matching"] == 10
    kpis = {r["kpi_id"]: r["value"] for r in spark.read.parquet(os.path.join(tmpdir_path, "out", "kpis")).collect()}
    assert kpis["total_revenue"] == sum(range(1, 51))
