"""Operator 11: alignment of two tokenizers' tokens by pointer jumping.

Both tokenizers cut the same bytes (a blank and the text). Every token points
to the token of the other side that overlaps it and ends farthest to the
right, if that one ends later; of two tokens that end together, the one of
tokenizer A points to the one of B, which points to itself. Successors are
doubled for all tokens of a chunk at once (``s = s[s]``) until nothing moves:
then every token points to the terminal token of its component, the byte
offset at which both sides end. Tokens with the same terminal are a group, and
the two tokens that end there are a link.

A link's id pair is counted over the corpus: texts are handled in blocks, and
a block sends each of its distinct pairs once to be counted, and gets each
pair's count back. So a pair that is in every text costs a row a block, and a
block's texts are encoded once and written.

Both encoders work on distinct words. Tokenizer A's pre-tokens are independent
of each other. In tokenizer B no piece has a blank after another character
(checked when it is loaded; else texts are encoded whole), so no merge goes
over the place before a run of blanks, and the runs of blanks with the word
after them can be encoded one by one. A long text is cut at single blanks
between other characters, where both tokenizers cut and a group ends.

Edge cases: a null or empty text, and one whose joined tokens of A or B differ
from a blank and the text (as one with U+2581, which B reads as a blank), have
no tokens: all numbers 0, groups ''. Null ids are kept; repeated rows are
documents of their own and count as often; other columns are ignored; an empty
table gives none. Special tokens' strings are plain text. Characters that
this Python's Unicode tables do not know are split by tokenizer A's library.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm.common import list_array, prepare_python, ranges, shared_table
from veritable.llm.pieces import Chunk, PieceIds, byte_alphabet, tokenizer_path

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: UTF-8 bytes that are encoded and grouped at a time, and of a block of texts (a longer text is a block of its own).
PART_BYTES, BLOCK_BYTES = 1 << 20, 4 << 20
#: Bits of B's id in a pair, and of a pair in (text, pair): both vocabularies must fit.
B_BITS, PAIR_BITS = 20, 40
#: Segments up to this many bytes are remembered, so many of them in each Python worker.
KEPT_BYTES, KEPT = 64, 200_000

CUT = re.compile(r"(?<=\S) (?=\S)")


class Vocabulary:
    """Bytes of every id: ``flat[begin[i] : begin[i] + size[i]]``."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(x) for x in entries], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ranges(self.begin[ids], self.size[ids])]


@functools.lru_cache(maxsize=1)
def unassigned() -> np.ndarray:
    """Code points that this Python's Unicode tables have no character for."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


class ByteSide:
    """Tokenizer A: byte-level BPE of a tokenizers file; special strings are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        entries = [b""] * (1 + max(*whole["model"]["vocab"].values(), *[x["id"] for x in whole["added_tokens"]]))
        for piece, i in whole["model"]["vocab"].items():
            entries[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
        self.vocabulary = Vocabulary(entries)
        self.words = PieceIds(path, KEPT)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids of each text)."""
        flat, sizes = self.words.encode(Chunk(texts, "byte", {}))
        if not any(not t.isascii() and unassigned()[np.frombuffer(t.encode("utf-32-le"), np.uint32)].any() for t in texts):
            return flat.astype(np.int64), sizes
        ends, parts = np.cumsum(sizes), []
        for k, t in enumerate(texts):
            own = flat[ends[k] - sizes[k]:ends[k]]
            if not t.isascii() and unassigned()[np.frombuffer(t.encode("utf-32-le"), np.uint32)].any():
                own = np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4")
                sizes[k] = len(own)
            parts.append(own)
        return np.concatenate(parts).astype(np.int64), sizes


class PieceSide:
    """Tokenizer B: a sentencepiece model that puts a blank before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.blank = self.model.piece_to_id("▁")
        self.apart = self.blank != self.model.unk_id() and not any(re.search("[^▁]▁", p) for p in pieces)
        self.vocabulary = Vocabulary([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                                      for i, p in enumerate(pieces)])
        self.seen: dict[bytes, np.ndarray] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids of each text); each text begins with the blank that the model adds."""
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.cumsum([0, *map(len, raw[:-1])])
        first = np.zeros(len(data), bool)
        if self.apart:
            blank = data == 0x20
            first[1:] = blank[1:] & ~blank[:-1]
        first[starts] = True
        at = np.flatnonzero(first)
        offsets = np.append(at, len(data)).astype(np.int32)
        segments = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        code, words = segments.indices.to_numpy(), segments.dictionary.to_pylist()
        table = [self.seen.get(w) for w in words]
        new = [i for i, ids in enumerate(table) if ids is None]
        for i, ids in zip(new, self.model.encode([words[i][1:].decode() for i in new], num_threads=1), strict=True):
            table[i] = np.array([self.blank] if words[i] == b" " else ids, np.int64)  # the model adds no blank to nothing
            if len(words[i]) <= KEPT_BYTES and len(self.seen) < KEPT:
                self.seen[words[i]] = table[i]
        sizes = np.array([len(x) for x in table], np.int64)
        flat, begin, own = np.concatenate(table), np.cumsum(sizes) - sizes, sizes[code]
        text = np.searchsorted(starts, at, "right") - 1
        return flat[ranges(begin[code], own)], np.bincount(text, weights=own, minlength=len(texts)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(path_a), PieceSide(path_b)


def terminals(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the tokens of A and of B, by their sizes in bytes: the token of B that ends their component."""
    n_a, n_b = len(size_a), len(size_b)
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    holds_a, holds_b = np.repeat(np.arange(n_a), size_a), np.repeat(np.arange(n_b), size_b)
    to_b = holds_b[end_a - 1]  # of what overlaps a token, the one that holds its last byte ends last
    to_a = holds_a[end_b - 1]
    succ = np.concatenate([n_a + to_b, np.where(end_a[to_a] == end_b, n_a + np.arange(n_b), to_a)])
    while True:
        jumped = succ[succ]
        if np.array_equal(jumped, succ):
            return succ[:n_a] - n_a, succ[n_a:] - n_a
        succ = jumped


def written(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each group): ``a1,a2|b1;`` of every group, with its last sign; groups are numbered from 0 on."""
    n = int(group_b[-1]) + 1 if len(group_b) else 0
    until_a, until_b = np.cumsum(np.bincount(group_a, minlength=n)), np.cumsum(np.bincount(group_b, minlength=n))
    place = np.concatenate([np.arange(len(ids_a)) + (until_b[group_a] - np.bincount(group_b, minlength=n)[group_a]),
                            np.arange(len(ids_b)) + until_a[group_b]])
    ids = np.empty(len(place), np.int64)
    ids[place] = np.concatenate([ids_a, ids_b])
    sign = np.full(len(place), ord(","), np.uint8)
    sign[place[until_a - 1]] = ord("|")
    sign[place[len(ids_a) + until_b - 1]] = ord(";")
    digits = np.ones(len(ids), np.int64)
    top = int(ids.max(initial=0))
    for power in range(1, len(str(top))):
        digits += ids >= 10**power
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = sign
    for power in range(len(str(top))):
        has = digits > power
        out[ends[has] - 2 - power] = ord("0") + ids[has] // 10**power % 10
    return out, ends[place[len(ids_a) + until_b - 1]]


class Part:
    """The groups and links of a list of texts (each with its leading blank)."""

    def __init__(self, texts: list[str], a: ByteSide, b: PieceSide):
        raw = [t.encode() for t in texts]
        (ids_a, n_a), (ids_b, n_b) = a.encode(texts), b.encode(texts)
        size = np.array([len(x) for x in raw], np.int64)
        self.good = np.ones(len(texts), bool)
        for v, ids, n in ((a.vocabulary, ids_a, n_a), (b.vocabulary, ids_b, n_b)):
            own = np.add.reduceat(v.size[ids], np.cumsum(n) - n) if (n > 0).all() else np.full(len(n), -1)
            self.good &= own == size
            if self.good.all() and not np.array_equal(v.joined(ids), np.frombuffer(b"".join(raw), np.uint8)):
                ends, begin = np.cumsum(n), np.cumsum(n) - n
                self.good &= [v.joined(ids[s:e]).tobytes() == x for s, e, x in zip(begin, ends, raw, strict=True)]
        if not self.good.all():
            if len(texts) > 1:  # each by itself: such texts are few
                parts = [Part([t], a, b) for t in texts]
                self.good = np.concatenate([p.good for p in parts])
                self.n_a, self.n_b, self.n_groups = (np.concatenate([getattr(p, k) for p in parts]) for k in ("n_a", "n_b", "n_groups"))
                self.pairs = np.concatenate([p.pairs for p in parts])
                self.groups = [g for p in parts for g in p.groups]
                return
            ids_a, ids_b, n_a, n_b = ids_a[:0], ids_b[:0], n_a * 0, n_b * 0
        to_a, to_b = terminals(a.vocabulary.size[ids_a], b.vocabulary.size[ids_b])
        last = np.flatnonzero(to_b == np.arange(len(to_b)))
        number = np.cumsum(to_b == np.arange(len(to_b))) - 1
        group_a, group_b = number[to_a], number[to_b]
        self.n_a, self.n_b = n_a, n_b
        text_b = np.repeat(np.arange(len(texts)), n_b)
        self.n_groups = np.bincount(text_b[last], minlength=len(texts))
        closing = np.cumsum(np.bincount(group_a, minlength=len(last))) - 1 if len(last) else last
        self.pairs = ids_a[closing] << B_BITS | ids_b[last]
        out, ends = written(ids_a, ids_b, group_a, group_b)
        edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(self.n_groups)])]
        self.groups = [out[s:e].tobytes()[:-1] for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def slices(text: str, limit: int) -> Iterator[str]:
    """``text`` in parts of about ``limit`` characters, cut before single blanks between other characters."""
    done = 0
    while len(text) - done > limit:
        m = CUT.search(text, done + limit)
        if not m:
            break
        yield text[done:m.start()]
        done = m.start()
    yield text[done:]


BLOCKS = ("block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, "
          "pairs array<long>, times array<long>, sizes array<int>, codes array<int>, counts array<int>")


def encoded_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                   keep: bool = False) -> DataFrame:
    """One row a block of texts: per-text numbers, the block's distinct pairs, and which of them a text has how often."""
    prepare_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32  # unique in one writing of the table
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if held and size + len(t or "") > BLOCK_BYTES:
                    yield _block(number, held, path_a, path_b, keep)
                    number, held, size = number + 1, [], 0
                held.append((i, t))
                size += len(t or "")
        if held:
            yield _block(number, held, path_a, path_b, keep)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, BLOCKS + (", groups array<string>" if keep else ""))


def _block(number: int, rows: list[tuple], path_a: str, path_b: str, keep: bool) -> pa.RecordBatch:
    a, b = sides(path_a, path_b)
    n = len(rows)
    totals = np.zeros((3, n), np.int64)
    good, digest = np.ones(n, bool), [hashlib.sha256() for _ in rows]
    kept: list[list[bytes]] = [[] for _ in rows]
    found: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    texts: list[str] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        part = Part(texts, a, b)
        for k, (doc, own) in enumerate(zip(owner, part.groups, strict=True)):
            more = totals[2, doc] > 0
            totals[:, doc] += (part.n_a[k], part.n_b[k], part.n_groups[k])
            good[doc] &= part.good[k]
            digest[doc].update(b";" + own if more else own)
            if keep:
                kept[doc].append(own)
        key, times = np.unique(np.repeat(np.array(owner), part.n_groups) << PAIR_BITS | part.pairs, return_counts=True)
        found.append(key)
        counts.append(times)

    for doc, (_, text) in enumerate(rows):
        for own in slices(" " + text, PART_BYTES) if text else ():
            if texts and size + len(own) > PART_BYTES:
                flush()
                texts, owner, size = [], [], 0
            texts.append(own)
            owner.append(doc)
            size += len(own)
    if texts:
        flush()
    key, at = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_inverse=True)
    times = np.bincount(at, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64) if found else np.empty(0, np.int64)
    fine = good[key >> PAIR_BITS] if len(key) else np.empty(0, bool)
    key, times = key[fine], times[fine]
    totals[:, ~good] = 0
    pairs, code = np.unique(key & ((1 << PAIR_BITS) - 1), return_inverse=True)
    digests = [d.hexdigest() if g and k else "" for d, g, k in zip(digest, good, totals[2], strict=True)]
    one = lambda values, kind: list_array(values, np.array([len(values)]), kind)
    columns = [pa.array([number], pa.int64()), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
               *[one(x, pa.int64()) for x in totals], pa.array([digests], pa.list_(pa.string())),
               one(pairs, pa.int64()), one(np.bincount(code, weights=times, minlength=len(pairs)).astype(np.int64), pa.int64()),
               one(np.bincount(key >> PAIR_BITS, minlength=n), pa.int32()), one(code, pa.int32()), one(times, pa.int32())]
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    if keep:
        columns.append(pa.array([[b";".join(x).decode() if g else "" for x, g in zip(kept, good, strict=True)]], pa.list_(pa.string())))
        names.append("groups")
    return pa.RecordBatch.from_arrays(columns, names)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, links, best): corpus-wide links of each id pair, and whether no pair of its B id has more."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("links"))
    b = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    most = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
          keep: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and, with ``keep``, ``groups``."""
    blocks = shared_table(encoded_blocks(docs, path_a, path_b, id_col, text_col, keep), "aligned")
    counts = pair_counts(blocks)
    asked = blocks.select("block", F.explode("pairs").alias("pair"))
    answers = asked.join(counts, "pair").select(*[F.col(c).alias(c) for c in ("block", "pair", "links", "best")])
    texts = blocks.drop("times")
    schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
              + (", groups string" if keep else ""))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _with_counts(left, right, keep)

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def _with_counts(block: pa.Table, answers: pa.Table, keep: bool) -> pa.Table:
    if block.num_rows != 1:
        raise ValueError(f"a block came {block.num_rows} times")
    own = {c: block.column(c).combine_chunks().flatten() for c in block.column_names if c != "block"}
    pairs = own["pairs"].to_numpy()
    pair, links, best = (answers.column(c).to_numpy() for c in ("pair", "links", "best"))
    order = np.argsort(pair)
    if not np.array_equal(pair[order], pairs):
        raise ValueError("a block got back other pairs than it sent")
    links, best = links[order], best[order].astype(np.int64)
    sizes, code, times = (own[c].to_numpy().astype(np.int64) for c in ("sizes", "codes", "counts"))
    text = np.repeat(np.arange(len(sizes)), sizes)
    summed = np.zeros((2, len(sizes)), np.int64)
    np.add.at(summed[0], text, best[code] * times)
    np.add.at(summed[1], text, links[code] * times)
    out = {"doc_id": own["ids"], "n_a": own["n_a"], "n_b": own["n_b"], "n_groups": own["n_groups"], "n_links": own["n_groups"],
           "n_best": pa.array(summed[0]), "count_sum": pa.array(summed[1]), "groups_sha256": own["digests"]}
    if keep:
        out["groups"] = own["groups"]
    return pa.table(out)


def default_paths() -> tuple[str, str]:
    return tokenizer_path(A_FILE), tokenizer_path(B_FILE)
