"""Operator 11 against the tokenizers' libraries and a walk over byte offsets."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from veritable.llm import token_align

PATHS = token_align.default_paths()


@pytest.fixture(scope="module")
def library():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def plain(rows, library):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row, one token after the other."""
    a, b = library
    back = {c: i for i, c in enumerate(token_align.byte_alphabet())}
    docs = []
    for doc, text in rows:
        if not text:
            docs.append((doc, [], [], []))
            continue
        whole = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append((doc, [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            own = ([], [])
            while i < len(ids_a) and ends_a[i] <= cut:
                own[0].append(ids_a[i])
                i += 1
            while j < len(ids_b) and ends_b[j] <= cut:
                own[1].append(ids_b[j])
                j += 1
            groups.append(own)
        docs.append((doc, ids_a, ids_b, groups))
    count = Counter((g[0][-1], g[1][-1]) for _, _, _, groups in docs for g in groups)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(n, most.get(y, 0))
    out = []
    for doc, ids_a, ids_b, groups in docs:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc, len(ids_a), len(ids_b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), text))
    return out


def digest(rows):
    return sorted(((*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "", r[7]) for r in rows), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_edge_texts(spark, docs, edges, library):
    rows = [*edges, (20, "a▁b"), (21, "ends in blanks   "), (22, " "), (23, "   three before"), (24, "<s> </s> <unk> <0x41> <|endoftext|>"),
            (25, "\r\n;\r }\r  x \t y"), (26, "\U0001fae9 Ᲊ new letters ࢏"), (27, "12345 ٣٤ ½² 中文字 ɐɑ"), (28, "x" * 3_000 + " y" * 3_000)]
    got = result(token_align.align(docs(rows), *PATHS, keep=True))
    assert got == digest(plain(rows, library))


def test_parts_and_blocks(spark, docs, sample, library, monkeypatch):
    """Texts cut into parts, and several blocks, give the same."""
    rows = [(i, t) for i, t in sorted(sample.items())][:60]
    whole = result(token_align.align(docs(rows), *PATHS, keep=True))
    assert whole == digest(plain(rows, library))
    monkeypatch.setattr(token_align, "PART_BYTES", 300)
    monkeypatch.setattr(token_align, "BLOCK_BYTES", 2_000)
    a, b = token_align.sides(*PATHS)
    for doc, text in rows[:20]:
        block = token_align._block(0, [(doc, text), (None, "a b"), (5, None)], *PATHS, keep=True).to_pylist()[0]
        want = plain([(doc, text), (None, "a b"), (5, None)], (a.library, b.model))
        assert [block[k] for k in ("n_a", "n_b", "n_groups")] == [[w[i] for w in want] for i in (1, 2, 3)]
        assert block["groups"] == [w[7] for w in want]


def test_slices():
    text = "ab cd  ef gh\tij " * 50
    parts = list(token_align.slices(text, 20))
    assert "".join(parts) == text and len(parts) > 20
    assert all(p[0] == " " and p[1] != " " for p in parts[1:])


def test_pointer_jumping_by_hand():
    to_a, to_b = token_align.terminals(np.array([2, 2, 1, 3]), np.array([1, 2, 2, 3]))  # ends 2 4 5 8 and 1 3 5 8
    assert to_a.tolist() == [2, 2, 2, 3] and to_b.tolist() == [2, 2, 2, 3]


def test_empty_table_and_counts(spark, docs, library):
    assert token_align.align(docs([(1, "x")]).where("false"), *PATHS).collect() == []
    rows = [(i, "same text here") for i in range(40)] + [(50, None), (51, "same other")]
    assert result(token_align.align(docs(rows), *PATHS, keep=True)) == digest(plain(rows, library))
