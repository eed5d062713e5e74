"""Documents to training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again before the next one. All but the last return the columns of
``documents``:

1. ``language_id`` learns the labelled languages, drops documents that are in
   none of them (those without text or a letter, and those that take more than
   ``FOREIGN`` bits a byte under every one) and sets ``lang`` to the language
   found, whatever the label was.
2. ``line_dedup`` takes repeated lines out; a document that had text and is
   left without any was copied whole and goes.
3. ``near_duplicates`` keeps one document of each group of near copies.
4. ``secret_scan`` replaces every secret by a mark.
5. ``packing`` encodes what is left and packs the documents of each ``lang``
   into sequences of their own.

Edge cases follow the operators: null texts go in stage 1, null ids stay, rows
that share an id are one document from stage 3 on, an empty table gives an
empty result, and further columns are carried through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritable.llm import lang_id, line_dedup, ngram_join, packing, secret_scan
from veritable.llm.common import shared_table, table


#: Bits a byte (8 where nothing is known) beyond which a text is in none of the learned languages; theirs take 1 to 4.
FOREIGN = 5.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.accepted(docs, lang_id.learned(docs), foreign=FOREIGN, lang_col="lang")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(docs.withColumnRenamed("n_lines", "_n_lines").withColumnRenamed("n_dropped", "_n_dropped"))
    kept = found.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S")).drop("n_lines", "n_dropped")
    kept = kept.withColumnRenamed("_n_lines", "n_lines").withColumnRenamed("_n_dropped", "n_dropped")
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text = secret_scan.redacted_text(F.col("text"), inside=True)
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.default_path(), group_col="lang")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: Byte contexts, tokens and packing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return docs
