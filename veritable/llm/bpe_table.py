"""Operator 4: BPE encoding and decoding through a table of distinct words.

Texts are split into words where they lie. A block of texts (bounded by its
distinct words and its word count) becomes a list of word numbers plus one
row per distinct word. Those rows meet by word, each distinct word is encoded
once, and its ids are sent back to the blocks, where they are put in the
places of the word numbers. Decoding turns ids into pieces by an equi-join
with the vocabulary (as many rows as the tokenizer file has, so that side has
a fixed size), for the ids of the distinct words.

Both branches split the same scan, so nothing but word numbers and distinct
words is shuffled. Blocks are numbered by scan partition, whose order is
fixed by the files; the block checks the words it gets back by count.

Edge cases: a null text is empty (no ids, empty decoding); a null id is
carried through; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritable.llm.common import prepare_python, ranges, shared_table, text_chunks
from veritable.llm.pieces import Chunk, PieceIds, special_ids

#: A block ends when it has this many distinct words or words (each is 4 bytes of a block's memory).
BLOCK_WORDS, BLOCK_LENGTH = 500_000, 16_000_000


def _pack(values: np.ndarray) -> bytes:
    """Compressed 32-bit integers, byte planes apart."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


class _Block:
    def __init__(self, number: int):
        self.number, self.words, self.ids, self.sizes, self.codes, self.length = number, {}, [], [], [], 0

    def add(self, ids, chunk: Chunk) -> None:
        own = np.fromiter((self.words.setdefault(w, len(self.words)) for w in chunk.words.to_pylist()), np.int64,
                          len(chunk.words))
        self.ids += ids
        self.sizes.append(np.bincount(chunk.doc, minlength=chunk.n))
        self.codes.append(own[chunk.code] if len(chunk.code) else np.empty(0, np.int64))
        self.length += len(chunk.code)


def _blocks(batches, path: str) -> Iterator[_Block]:
    start = TaskContext.get().partitionId() << 32
    block, specials = _Block(start), special_ids(path)
    for ids, texts in text_chunks(batches, "id", "text"):
        chunk = Chunk([t or "" for t in texts], "word", specials)
        if block.ids and (len(block.words) + len(chunk.words) > BLOCK_WORDS or block.length + len(chunk.code) > BLOCK_LENGTH):
            yield block
            block = _Block(block.number + 1)
        block.add(ids, chunk)
    if block.ids:
        yield block


def distinct_words(docs: DataFrame, path: str) -> DataFrame:
    """(word, block, place): the distinct words of each block of (id, text) rows."""

    def run(batches):
        for block in _blocks(batches, path):
            words = list(block.words)
            for a in range(0, len(words), 50_000):
                part = words[a:a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()).cast(pa.string()), pa.array(np.full(len(part), block.number)),
                     pa.array(np.arange(a, a + len(part), dtype=np.int32))], ["word", "block", "place"])

    return docs.mapInArrow(run, "word string, block long, place int")


def word_numbers(docs: DataFrame, path: str) -> DataFrame:
    """(block, ids, sizes, codes, words): the texts of each block as word numbers."""

    def run(batches):
        for block in _blocks(batches, path):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.number]), pa.array([block.ids], pa.list_(pa.int64())),
                 pa.array([np.concatenate(block.sizes).astype(np.int32)], pa.list_(pa.int32())),
                 pa.array([_pack(np.concatenate(block.codes))], pa.binary()),
                 pa.array([len(block.words)], pa.int32())],
                ["block", "ids", "sizes", "codes", "words"])

    return docs.mapInArrow(run, "block long, ids array<long>, sizes array<int>, codes binary, words int")


def encode_words(words: DataFrame, path: str, partitions: int) -> DataFrame:
    """(block, places, sizes, tokens): rows of a word meet, it is encoded once, each block gets its share."""

    def run(batches):
        encoder, specials = PieceIds(path, size=0), {k.encode(): v for k, v in special_ids(path).items()}
        out: dict[int, tuple[list, list, list]] = {}
        last, ids, held = None, b"", 0

        def flush():
            for number, (places, sizes, tokens) in out.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([_pack(np.array(places, np.int64))], pa.binary()),
                     pa.array([_pack(np.array(sizes, np.int64))], pa.binary()),
                     pa.array([_pack(np.frombuffer(b"".join(tokens), "<u4"))], pa.binary())],
                    ["block", "places", "sizes", "tokens"])

        for batch in batches:  # sorted by word
            for word, block, place in zip(batch.column("word").cast(pa.binary()).to_pylist(),
                                          batch.column("block").to_pylist(), batch.column("place").to_pylist(),
                                          strict=True):
                if word != last:
                    last = word
                    ids = np.array([specials[word]], "<u4").tobytes() if word in specials else encoder.ids(word)
                row = out.setdefault(block, ([], [], []))
                row[0].append(place)
                row[1].append(len(ids) // 4)
                row[2].append(ids)
                held += 1
            if held > 1_000_000:
                yield from flush()
                out, held = {}, 0
        yield from flush()

    met = words.repartition(partitions, "word").sortWithinPartitions("word")
    return met.mapInArrow(run, "block long, places binary, sizes binary, tokens binary")


def block_words(shares: DataFrame) -> DataFrame:
    """(block, sizes, tokens, used): the ids of each block's words in the order of their numbers, and its distinct ids."""

    def run(parts: pa.Table) -> pa.Table:
        places, sizes, tokens = ([_unpack(x) for x in parts.column(c).to_pylist()] for c in ("places", "sizes", "tokens"))
        at, own, flat = np.concatenate(places), np.concatenate(sizes).astype(np.int64), np.concatenate(tokens)
        order = np.argsort(at)
        if not np.array_equal(at[order], np.arange(len(at))):
            raise ValueError("a block's words are not complete")
        begin = np.cumsum(own) - own
        return pa.table({"block": parts.column("block").slice(0, 1), "sizes": pa.array([_pack(own[order])], pa.binary()),
                         "tokens": pa.array([_pack(flat[ranges(begin[order], own[order])])], pa.binary()),
                         "used": pa.array([np.unique(flat).astype(np.int32)], pa.list_(pa.int32()))})

    return shares.groupBy("block").applyInArrow(run, "block long, sizes binary, tokens binary, used array<int>")


def id_to_piece(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): the tokenizer's vocabulary with its special tokens; its size is the tokenizer file's."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    pieces = {**{v: k for k, v in whole["model"]["vocab"].items()},
              **{x["id"]: x["content"] for x in whole["added_tokens"]}}
    return spark.createDataFrame(list(pieces.items()), "id int, piece string")


def decode_ids(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded): token lists decoded by an equi-join of their ids with the vocabulary.

    The key must be unique and not null. An empty or null list decodes to ''.
    Ids outside the vocabulary give nothing, as in the library. For tokenizer
    files without a decoder: pieces joined by one space.
    """
    pieces = F.broadcast(id_to_piece(encoded.sparkSession, path))  # as many rows as the vocabulary file
    each = encoded.select(key, F.posexplode(ids).alias("at", "id")).join(pieces, "id")
    found = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"))
    found = found.select(key, F.array_join(F.col("p.piece"), " ").alias("decoded"))
    return encoded.select(key).join(found, key, "left").select(key, F.coalesce("decoded", F.lit("")).alias("decoded"))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                  keep: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with ``keep``, ``ids`` and ``decoded``.

    The vocabulary join is made for the distinct ids of each block.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    held = shared_table(block_words(encode_words(distinct_words(rows, path), path, partitions)), "words")
    pieces = F.broadcast(id_to_piece(spark, path))  # as many rows as the vocabulary file
    used = held.select("block", F.explode("used").alias("id")).distinct().join(pieces, "id")
    used = used.groupBy("block").agg(F.collect_list(F.struct("id", "piece")).alias("vocabulary"))
    parts = held.drop("used").unionByName(used, allowMissingColumns=True)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<long>, decoded string" if keep else ""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _placed(left, right, keep)

    return parts.groupBy("block").cogroup(word_numbers(rows, path).groupBy("block")).applyInArrow(run, schema)


def _placed(parts: pa.Table, block: pa.Table, keep: bool) -> pa.Table:
    """The texts of one block: ids of its words put in the places of the word numbers, and decoded."""
    if block.num_rows != 1:
        raise ValueError(f"a block came {block.num_rows} times")
    n_words = block.column("words")[0].as_py()
    piece: dict[int, str] = {}
    size, flat = np.empty(0, np.int64), np.empty(0, "<u4")
    for row in parts.to_pylist():
        if row["vocabulary"] is not None:
            piece.update((x["id"], x["piece"]) for x in row["vocabulary"])
        else:
            size, flat = _unpack(row["sizes"]).astype(np.int64), _unpack(row["tokens"])
    if len(size) != n_words:
        raise ValueError("a block got back another number of words than it sent")
    begin = np.cumsum(size) - size
    words = [" ".join([piece[t] for t in flat[b:b + n].tolist()]) for b, n in zip(begin.tolist(), size.tolist(), strict=True)]
    out: dict[str, list] = {k: [] for k in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
    codes, done = _unpack(block.column("codes")[0].as_py()).astype(np.int64), 0
    for doc, n in zip(block.column("ids")[0].as_py(), block.column("sizes")[0].as_py(), strict=True):
        own = codes[done:done + n]
        done += n
        ids = flat[ranges(begin[own], size[own])]
        decoded = " ".join([words[c] for c in own.tolist()])
        out["doc_id"].append(doc)
        out["n_tokens"].append(len(ids))
        out["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
        if keep:
            out["ids"].append(ids.astype(np.int64).tolist())
            out["decoded"].append(decoded)
    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int64())}
    return pa.table({k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items() if keep or k not in ("ids", "decoded")})
