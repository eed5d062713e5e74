"""Operator 3: language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to ``order`` bytes with the
counts of the bytes that followed. The code length of a byte is that of the
longest known context: -log2(count / (total + distinct)) if the byte was seen
there, else the escape -log2(distinct / (total + distinct)) plus its length in
the context one byte shorter, and 8 bits below the empty context (escape
method C, statistics frozen after training). A text's code length is summed
over all its bytes, and the language with the shortest one is predicted.

As the statistics are frozen, a byte's length depends only on the bytes
before it that fit a context. So a chunk of texts is reduced to its distinct
(context, byte) grams, the trees are walked once for each of these, and the
lengths are added up by text: the sum over every byte, in whole-array steps.

Training takes whole texts of at most ``rows_per_lang`` labelled rows of each
language, chosen by a hash of their text (a documented bound; 0: all rows).

Edge cases: a text that is null or has no letter is ``und`` with score 0; so
is every text if no row can be learned from. Ties go to the smaller language
name. A null id is carried through, repeated rows each give a row, and
columns other than those named are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritable.llm.common import CHUNK_BYTES, prepare_python, text_chunks

ORDER, ROWS_PER_LANG, UNKNOWN = 3, 400, "und"
#: Rows a language drawn beyond twice the wanted ones: at random hashes, that so few fall short has a chance below 1e-15.
SPARE = 60
ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram of every byte of all texts, bytes per text).

    A gram holds the byte in its lowest 8 bits, the byte before it above
    these, and so on up to ``order`` bytes before; bits 56 and up hold how
    many bytes of context there are (fewer at a text's start).
    """
    data = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    b = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    depth = np.minimum(np.arange(len(b)) - first, order).astype(np.uint64)
    out = b.copy()
    for k in range(1, order + 1):
        out[k:] |= np.where(depth[k:] >= k, b[:-k] << np.uint64(8 * k), np.uint64(0))
    return out | depth << np.uint64(56), sizes


@dataclass
class Model:
    """Frozen statistics: for each language and context length, sorted contexts and (context, byte) pairs."""

    order: int
    langs: list[str]
    contexts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]  # keys, totals, distinct
    pairs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]  # keys, counts

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length in bits of each gram under each language: walk from its longest context down."""
        out = np.zeros((len(gram), len(self.langs)))
        depth = (gram >> np.uint64(56)).astype(np.int64)
        for lang in range(len(self.langs)):
            todo = np.arange(len(gram))
            for k in range(self.order, -1, -1):
                here = todo[depth[todo] >= k]
                if (lang, k) not in self.contexts or not len(here):
                    continue
                pair = gram[here] & np.uint64((1 << (8 * (k + 1))) - 1)
                keys, total, distinct = self.contexts[lang, k]
                at = np.minimum(np.searchsorted(keys, pair >> np.uint64(8)), len(keys) - 1)
                known = keys[at] == pair >> np.uint64(8)
                here, pair, at = here[known], pair[known], at[known]
                p_keys, p_counts = self.pairs[lang, k]
                p_at = np.minimum(np.searchsorted(p_keys, pair), len(p_keys) - 1)
                seen = p_keys[p_at] == pair
                whole = (total + distinct)[at]
                out[here, lang] += np.log2(whole / np.where(seen, p_counts[p_at], distinct[at]))
                left = np.ones(len(gram), bool)
                left[here[seen]] = False
                todo = todo[left[todo]]
            out[todo, lang] += 8.0
        return out

    def code_lengths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits of each text under each language, bytes of each text)."""
        gram, sizes = grams(texts, self.order)
        distinct, where = np.unique(gram, return_inverse=True)
        bits = self.bits(distinct)
        doc = np.repeat(np.arange(len(texts)), sizes)
        out = np.empty((len(texts), len(self.langs)))
        for lang in range(len(self.langs)):
            out[:, lang] = np.bincount(doc, weights=bits[where, lang], minlength=len(texts))
        return out, sizes


def training_rows(docs: DataFrame, rows_per_lang: int, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text): the ``rows_per_lang`` distinct texts of smallest 64-bit hash of each language, or all if it has fewer."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang IS NOT NULL AND length(text) > 0")
    if not rows_per_lang:
        return rows
    rows = rows.withColumn("at", F.xxhash64("text"))
    # Somewhat more than the wanted share of the hash range first, so that only about as many rows as are wanted are
    # numbered by language. The labels are broadcast: the model that is built holds all of them anyway.
    share = rows.select("lang", "at").distinct().groupBy("lang").agg(
        (F.lit(2.0 * rows_per_lang + SPARE) / F.count(F.lit(1))).alias("upto"))
    near = rows.join(F.broadcast(share), "lang").where(F.col("at") / F.lit(2.0**64) + 0.5 <= F.col("upto"))
    near = near.groupBy("lang", "at").agg(F.min("text").alias("text"))  # one of a group of copies
    order = Window.partitionBy("lang").orderBy("at")
    return near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows_per_lang).select("lang", "text")


def train(rows: DataFrame, order: int = ORDER) -> Model:
    """Context trees of (lang, text) rows; only the summed counts of the bounded sample reach the driver."""
    prepare_python(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                gram, _ = grams(texts, order)
                depth = gram >> np.uint64(56)
                for k in range(order + 1):
                    keys, n = np.unique(gram[depth >= k] & np.uint64((1 << (8 * (k + 1))) - 1), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), k, np.int32)),
                         pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "k", "pair", "n"])

    counts = rows.mapInArrow(run, "lang string, k int, pair long, n long")
    counts = counts.groupBy("lang", "k", "pair").agg(F.sum("n").alias("n")).toArrow()
    lang_of, k_of = np.array(counts.column("lang").to_pylist(), object), counts.column("k").to_numpy()
    pair_of, n_of = counts.column("pair").to_numpy().astype(np.uint64), counts.column("n").to_numpy()
    model = Model(order, sorted(set(lang_of)), {}, {})
    for i, lang in enumerate(model.langs):
        for k in range(order + 1):
            own = np.flatnonzero((lang_of == lang) & (k_of == k))
            if not len(own):
                continue
            own = own[np.argsort(pair_of[own])]
            keys, first, distinct = np.unique(pair_of[own] >> np.uint64(8), return_index=True, return_counts=True)
            model.pairs[i, k] = (pair_of[own], n_of[own].astype(float))
            model.contexts[i, k] = (keys, np.add.reduceat(n_of[own], first).astype(float), distinct.astype(float))
    return model


def judged(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(predicted language, score, bits a byte under it) of each text."""
    n = len(texts)
    lang, score, rate = [UNKNOWN] * n, np.zeros(n), np.zeros(n)
    own = [i for i, t in enumerate(texts) if has_letter(t)] if model.langs else []
    if own:
        bits, sizes = model.code_lengths([texts[i] for i in own])
        per = bits / sizes[:, None]
        low = per.min(axis=1)
        for i, best in zip(own, bits.argmin(axis=1).tolist(), strict=True):
            lang[i] = model.langs[best]
        score[own] = 1.0 / np.exp2(-32.0 * (per - low[:, None])).sum(axis=1)
        rate[own] = low
    return lang, score, rate


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, bits_per_byte`` of every whole text.

    ``score`` is the predicted language's share of 2 ^ -(code length per byte
    x 32): how clearly, over a stretch of 32 bytes, it codes the text better
    than the others do (0 to 1).
    """
    prepare_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches, "id", "text"):
            lang, score, rate = judged(texts, model)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lang, pa.string()), pa.array(score),
                                              pa.array(rate)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def held_out(id_col: str = "doc_id"):
    """Whether a document is held out of training: crc32 of its id as text is divisible by 5 (a null id is not)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, order: int = ORDER, rows_per_lang: int = ROWS_PER_LANG, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows that are not held out, predict all rows, and say which were held out."""
    model = learned(docs, order, rows_per_lang, id_col, text_col, lang_col)
    found = predict(docs, model, id_col, text_col)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "bits_per_byte")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", foreign: float = math.inf,
             lang_col: str | None = None) -> DataFrame:
    """Rows whose text has a language: not ``und``, and at most ``foreign`` bits a byte under its best model.

    Without a limit only ``und`` is rejected: short texts with an address or a
    key in them, and texts in two of the languages, take many bits as well. If
    no language could be learned, every text with a letter stays. With
    ``lang_col`` that column becomes the predicted language (it stays as it is
    if none could be learned). Rows are filtered where they lie, with all their
    columns.
    """
    prepare_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep, found, at = batch.column(text_col).to_pylist(), [], [], 0
            if not model.langs:
                yield batch.filter(pa.array([has_letter(t) for t in texts], pa.bool_()))
                continue
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to] or "") <= CHUNK_BYTES):
                    size += len(texts[to] or "")
                    to += 1
                lang, _, rate = judged(texts[at:to], model)
                keep += [x != UNKNOWN and r <= foreign for x, r in zip(lang, rate, strict=True)]
                found += lang
                at = to
            if lang_col is not None:
                k = batch.schema.get_field_index(lang_col)
                batch = batch.set_column(k, batch.schema.field(k), pa.array(found, batch.schema.field(k).type))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learned(docs: DataFrame, order: int = ORDER, rows_per_lang: int = ROWS_PER_LANG, id_col: str = "doc_id",
            text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the rows that are not held out."""
    return train(training_rows(docs.where(~held_out(id_col)), rows_per_lang, text_col, lang_col), order)
