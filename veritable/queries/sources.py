"""Source queries: delimited text written from the driver tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veritable.queries.registry import register
from veritable.session import ensure_checkpoint_dir
from veritable.sources import readers as R
from veritable.sources import records
from veritable.sources.tables import load


def _written(spark, df, name: str) -> str:
    """The table as CSV in the shared folder."""
    path = f"{ensure_checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}.csv"
    R.write_table(df, path, "csv")
    return path


@register("csv_quoted_pages", """
SELECT page_id, url, html FROM pages
""")
def csv_quoted_pages(spark, sf_dir):
    """Pages have quotes and line breaks in their html: quoted fields over many lines."""
    return R.read_table(spark, _written(spark, load(spark, sf_dir, "pages").select("page_id", "url", "html"), "pages"))


@register("csv_quoted_conversations", """
SELECT conv_id, turn, role, text FROM conversations
""")
def csv_quoted_conversations(spark, sf_dir):
    path = _written(spark, load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conversations")
    return R.read_delimited(spark, path, schema="conv_id long, turn int, role string, text string")


@register("csv_records_documents", """
SELECT count(*)::BIGINT AS records, sum(length(text) - length(replace(text, chr(10), '')))::BIGINT AS open_lines FROM documents
""")
def csv_records_documents(spark, sf_dir):
    """What the block scan counts without putting a record together: records, and lines that end inside quotes."""
    path = _written(spark, load(spark, sf_dir, "documents").select("doc_id", "text"), "documents")
    blocks = records.true_starts(records.scan_blocks(spark, path, ","))
    after = blocks.groupBy("file").agg(F.sum("open_lines").alias("o"), F.sum("records").alias("n"))
    return after.agg(F.sum(F.col("n") - 1).cast("long").alias("records"), F.sum("o").cast("long").alias("open_lines"))


@register("csv_titles_orders", """
SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders
""")
def csv_titles_orders(spark, sf_dir):
    """A report title above the names of every file, and semicolons: header repair from one look at the first file."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    path = f"{ensure_checkpoint_dir(spark)}/tables/titles-{uuid.uuid4().hex[:12]}.csv"
    body = F.concat_ws("\n", F.lit("Orders;;"), F.lit("o_orderkey;o_orderstatus;o_totalprice"),
                       F.array_join(F.collect_list(F.concat_ws(";", "o_orderkey", "o_orderstatus", "o_totalprice")), "\n"))
    parts = o.groupBy(F.floor(F.col("o_orderkey") / 4_000).alias("part")).agg(body.alias("value"))  # at most 4,000 orders a file
    parts.select("value", "part").write.partitionBy("part").text(path)
    back = R.read_table(spark, path, schema="o_orderkey long, o_orderstatus string, o_totalprice double")
    return back.select("o_orderkey", "o_orderstatus", "o_totalprice")
