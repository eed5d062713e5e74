"""Claim tests and KPIs re-run on each micro-batch of a file stream.

``monitor_claims`` reads new files of a directory as a stream, and for every
micro-batch runs the batch claim tests (M1-M3) and scalar KPIs on that batch,
appending one row per claim / KPI with the batch id to parquet tables under
the output folder. The checkpoint location gives exactly-once batches across
restarts and executor loss; it must be in shared storage on a cluster.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.operators import claims as M
from veritable.operators import kpis as K


def monitor_claims(spark: SparkSession, source_dir: str, schema: T.StructType, claims: list[M.Claim],
                   kpi_columns: K.KpiColumns, out_dir: str, checkpoint_dir: str, fmt: str = "parquet",
                   date: str | None = None, measure: str | None = None, once: bool = True):
    """Start the monitoring query; with ``once`` it processes what is there and stops."""
    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        tests = M.test_claims(batch, claims, date=date, measure=measure)
        tests.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(os.path.join(out_dir, "claims"))
        kpis = K.scalar_kpis(batch, kpi_columns)
        kpis.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(os.path.join(out_dir, "kpis"))

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
