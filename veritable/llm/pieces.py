"""Vectorised splitting of texts into the pre-tokens of the two BPE files.

The pre-token patterns are those of the public tokenizer files; they are
applied to whole chunks of code points at once instead of match by match:
every code point gets a class (letter, number, white space, other), a
pre-token starts where the class changes, and the pattern's special rules
(contractions, a leading space, single digits) move those starts.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, SPACE, END, SPECIAL = range(6)
#: Code points with Unicode's White_Space property (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
               0x3000]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point, by Unicode general category."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


@functools.lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for code points from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def byte_chars(piece: bytes) -> str:
    return piece.decode("latin-1").translate(_shift())


@functools.lru_cache(maxsize=1)
def _shift() -> dict[int, str]:
    return dict(enumerate(byte_alphabet()))


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@functools.lru_cache(maxsize=4)
def special_ids(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


def fold(text: str) -> str:
    """The word tokenizer's normal form: NFC, then each character's own lower case."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower() would pick the final form by context
            text = text.replace("Σ", "σ")
    return text.lower()


class Chunk:
    """The pre-tokens of a list of texts.

    ``segments``: all segments as one binary array over a shared buffer;
    ``keep``: which of them are pre-tokens (not separators, nor dropped white
    space); ``doc``: index of each kept one's text; ``code``/``words``:
    dictionary encoding of the kept ones; ``special``: which are special
    strings; ``start``/``stop``: code point offsets of the kept ones in the
    (normalised) text.
    """

    def __init__(self, texts: list[str], mode: str, specials: dict[str, int]):
        assert mode in ("word", "byte")
        parts, marks, at, self.n = [], [], 0, len(texts)
        ends = np.empty(len(texts), np.int64)
        found = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        for k, text in enumerate(texts):
            done = 0
            if found and "<|" in text:
                for m in found.finditer(text):
                    for raw, mark in ((text[done:m.start()], False), (m[0], True)):
                        part = fold(raw) if mode == "word" and not mark else raw
                        if mark:
                            marks.append((at, at + len(part)))
                        parts.append(part)
                        at += len(part)
                    done = m.end()
            part = text[done:] if done else text
            part = fold(part) if mode == "word" else part
            parts += (part, "\0")
            at += len(part)
            ends[k] = at
            at += 1
        whole = "".join(parts)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kind = classes()[cp]
        kind[ends] = END
        for a, b in marks:
            kind[a:b] = SPECIAL
        first = np.ones(len(cp), bool)
        if len(cp):
            np.not_equal(kind[1:], kind[:-1], out=first[1:])
        first[ends] = True
        for a, _ in marks:
            first[a] = True
        if mode == "word":
            first[kind == NUMBER] = True
        else:  # the last white space before a word: a blank joins the word, anything else stands alone
            last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
            first[last] = True
            first[last[cp[last] == 0x20] + 1] = False
        self._contractions(cp, kind, first)
        at_cp = np.flatnonzero(first)
        width = np.ones(len(cp), np.int32)
        for edge in (0x80, 0x800, 0x10000):
            width += cp >= edge
        offsets = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(width, out=offsets[1:])
        data = whole.encode("utf-8")
        seg_off = np.append(offsets[at_cp], len(data)).astype(np.int32)
        self.segments = pa.Array.from_buffers(pa.binary(), len(at_cp), [None, pa.py_buffer(seg_off), pa.py_buffer(data)])
        seg_kind = kind[at_cp]
        keep = seg_kind != END
        self.doc_all = np.cumsum(~keep) - ~keep
        if mode == "word":
            keep &= seg_kind != SPACE
        self.keep = np.flatnonzero(keep)
        self.doc = self.doc_all[self.keep]
        base = np.concatenate([[0], ends[:-1] + 1]) if len(texts) else np.empty(0, np.int64)
        stop = np.append(at_cp[1:], len(cp))
        self.start = at_cp[self.keep] - base[self.doc]
        self.stop = stop[self.keep] - base[self.doc]
        self.special = seg_kind[self.keep] == SPECIAL
        encoded = pc.take(self.segments, pa.array(self.keep)).dictionary_encode()
        self.code = encoded.indices.to_numpy()
        self.words = encoded.dictionary

    @staticmethod
    def _contractions(cp, kind, first) -> None:
        """An apostrophe that starts a pre-token takes s, t, m, d, re, ve or ll after it."""
        q = np.flatnonzero((cp[:-1] == 0x27) & first[:-1] & (kind[1:] == LETTER))
        if not len(q):
            return
        one = np.isin(cp[q + 1], [ord(c) for c in "stmd"])
        after = np.where(q + 2 < len(cp), cp[np.minimum(q + 2, len(cp) - 1)], 0)
        two = np.zeros(len(q), bool)
        for pair in ("re", "ve", "ll"):
            two |= (cp[q + 1] == ord(pair[0])) & (after == ord(pair[1]))
        first[q[one | two] + 1] = False
        first[q[one] + 2] = True
        first[q[two] + 3] = True

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value of each kept pre-token, by text."""
        return np.bincount(self.doc, weights=values, minlength=self.n).astype(np.int64)


class PieceIds:
    """Ids of a pre-token by the tokenizers library; the cache keeps the words met first, up to ``size``."""

    def __init__(self, path: str, size: int = 250_000):
        self.model = tokenizer(path).model
        self.special = {k.encode(): v for k, v in special_ids(path).items()}
        self.size, self.seen = size, {}

    def ids(self, word: bytes) -> bytes:
        """Ids of an ordinary pre-token as little-endian unsigned 32-bit integers."""
        out = self.seen.get(word)
        if out is None:
            out = np.array([t.id for t in self.model.tokenize(byte_chars(word))], "<u4").tobytes()
            if len(self.seen) < self.size:
                self.seen[word] = out
        return out

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids of all texts in order, ids per text)."""
        code, words = chunk.code, chunk.words.to_pylist()
        table = [self.ids(w) for w in words]
        if chunk.special.any():  # special strings come as segments of their own
            code = code.copy()
            for i in np.flatnonzero(chunk.special):
                table.append(np.array([self.special[words[chunk.code[i]]]], "<u4").tobytes())
                code[i] = len(table) - 1
        sizes = np.array([len(x) // 4 for x in table], np.int64)
        flat = np.frombuffer(b"".join(table), "<u4")
        from veritable.llm.common import ranges

        begin = np.cumsum(sizes) - sizes
        lengths = sizes[code] if len(code) else np.empty(0, np.int64)
        ids = flat[ranges(begin[code], lengths)] if len(code) else np.empty(0, "<u4")
        return ids, chunk.per_doc(lengths)


@functools.lru_cache(maxsize=2)
def piece_ids(path: str) -> PieceIds:
    return PieceIds(path)
