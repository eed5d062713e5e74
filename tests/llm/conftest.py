import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def docs(spark):
    """A maker of ``documents`` frames from (doc_id, text) or (doc_id, text, lang) rows, with clashing further columns."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), 7, "x", 1.5, "k") for r in rows]
        schema = ("doc_id long, text string, lang string, source string, n_chars long, id long, node string, key double, "
                  "row string")
        return spark.createDataFrame(full, schema).repartition(parts)

    return make


@pytest.fixture(scope="session")
def sample(spark):
    """doc_id -> text of the small driver table."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "it's I'm we'll 're 's  'sabc x\n\n y\t z  "), (5, "<|endoftext|>a <|startoftext|>"),
    (6, "İΣΑΣ é É 12 ½ x²\x85a b"), (7, "\0 a\0b"), (8, "日本語 テスト 😀😀 ñ'd"), (9, "word " * 30_000), (10, "a" * 5_000),
    (None, "no id"), (11, "twice"), (11, "twice"), (12, "<|startoftext|"),
]


@pytest.fixture(scope="session")
def edges():
    return EDGES
