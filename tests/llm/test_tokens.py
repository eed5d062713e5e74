"""Operators 1, 4 and 8 against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritable.llm import bpe_table, packing, pieces, token_counts


@pytest.fixture(scope="module")
def word():
    return pieces.tokenizer(token_counts.default_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_counts_and_cut(docs, sample, edges, word):
    rows = [*sample.items(), *[(k if k is None else k + 10_000, t) for k, t in edges]]
    got = token_counts.token_budget(docs(rows), token_counts.default_path(), 50).collect()
    assert len(got) == len(rows)
    texts = defaultdict(list)
    for k, t in rows:
        texts[k].append(t)
    for r in got:
        text = texts[r.doc_id][0] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(ids_of(word, text)))
        assert r.over_limit == (r.n_tokens > 50)
        if r.over_limit and "<|" not in text:
            folded = pieces.fold(text)
            rest = len(folded[r.cut:]) - len(folded[r.cut:].lstrip())
            assert len(ids_of(word, folded[:r.cut])) <= 50 < len(ids_of(word, folded[:r.cut + rest + 1]))


def test_every_prefix_of_words(word):
    bpe = token_counts.prefix_bpe(token_counts.default_path())
    rng = random.Random(4)
    words = ["tokenization", "aaaaaaa", "straße", "naïveté", "日本語", "x"] + [
        "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    for w in words:
        symbols = pieces.byte_chars(w.encode())
        last, n = bpe.prefixes(symbols)
        at = 0
        for k, ch in enumerate(w, 1):
            at += len(ch.encode())
            assert bpe.closed(symbols, last, n, at) == len(ids_of(word, w[:k]))


def test_prefix_table_answers_budgets(docs, word):
    text = "The quick brown fox, it's 12 o'clock."
    table = token_counts.prefix_table(docs([(1, text), (2, None)]), token_counts.default_path())
    row, empty = table.orderBy("doc_id").collect()
    assert empty.n_tokens == 0 and empty.stops == []
    assert [len(ids_of(word, text[:s])) for s in row.stops] == row.counts
    asked = table.where("doc_id = 1").select(token_counts.count_at(F.lit(row.stops[4])).alias("n"),
                                             token_counts.stop_within(F.lit(3)).alias("s")).first()
    assert asked.n == row.counts[4] and len(ids_of(word, text[:asked.s])) <= 3


def test_encode_decode(docs, sample, edges, word):
    rows = [*sample.items(), *[(k if k is None else k + 10_000, t) for k, t in edges]]
    out = bpe_table.encode_decode(docs(rows), token_counts.default_path())
    got = out.collect()
    assert len(got) == len(rows)
    texts = {k: t for k, t in rows}
    for r in got:
        ids = ids_of(word, texts[r.doc_id])
        decoded = word.decode(ids, skip_special_tokens=False)
        assert r.ids == ids and r.decoded == decoded and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    some = out.where("doc_id < 20").select("doc_id", F.col("ids").alias("tokens"))
    for r in bpe_table.decode_ids(some, token_counts.default_path(), ids="tokens").collect():
        assert r.decoded == word.decode(ids_of(word, texts[r.doc_id]), skip_special_tokens=False)


def test_blocks_split(docs, word, monkeypatch):
    monkeypatch.setattr(bpe_table, "BLOCK_WORDS", 10)
    rows = [(k, f"alpha beta w{k} gamma{k % 7}") for k in range(60)]
    got = bpe_table.encode_decode(docs(rows, 2), token_counts.default_path()).collect()
    assert {r.doc_id: r.ids for r in got} == {k: ids_of(word, t) for k, t in rows}


def check_packing(got, rows, capacity, path=None):
    tokenizer = pieces.tokenizer(path or packing.default_path())
    by, seq = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    total = 0
    for k, text in rows:
        ids = np.array([*ids_of(tokenizer, text), 2], "<u4")
        total += len(ids)
        at = 0
        for i, r in enumerate(sorted(by[k], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at) and (i == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(seq), -(-total // capacity)


def test_packing(docs, sample, edges):
    rows = [*sample.items(), *[(k + 10_000, t) for k, t in edges if k is not None and k != 11]]
    n, bound = check_packing(packing.pack_documents(docs(rows), packing.default_path()).collect(), rows, 1024)
    assert n <= bound * 1.02 + 1


def test_repeats_and_null_ids_are_packed(docs):
    rows = [(1, "a b c"), (1, "a b c"), (None, "x"), (None, None)]
    got = packing.pack_documents(docs(rows), packing.default_path()).collect()
    assert len(got) == 4 and len({r.sequence_id for r in got}) == 1
    assert sorted(r.offset for r in got)[0] == 0 and len({r.offset for r in got}) == 4


def test_fullest_is_optimal():
    rng = random.Random(3)
    for _ in range(200):
        space = rng.randint(1, 60)
        counts = {rng.randint(1, 60): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        items = [x for x, c in counts.items() for _ in range(c)]
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums if s + x <= space}
        found = packing.fullest(space, counts)
        assert sum(found) == max(sums) and all(found.count(x) <= counts[x] for x in found)


def test_empty_tables(docs):
    none = docs([(1, "x")]).where("false")
    assert token_counts.token_budget(none, token_counts.default_path(), 5).collect() == []
    assert bpe_table.encode_decode(none, token_counts.default_path()).collect() == []
    assert packing.pack_documents(none, packing.default_path()).collect() == []
