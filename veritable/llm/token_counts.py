"""Operator 1: exact token counts of every prefix, by prefix dynamic programming.

A word's BPE encoding is the only chain of tokens in which every neighbouring
pair is one that BPE itself would leave apart. So the last token of each
prefix follows from the last tokens of shorter prefixes: try the tokens that
end there, keep the one that may follow the last token before it. One pass
over a word gives the exact token count at each of its prefixes, open (more
letters follow) and closed (the text is cut there), and running sums over the
words give it for the whole text. Budget and truncation questions are then
lookups: nothing is encoded again.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); a null id is
carried through; repeated rows each give a row; other columns are ignored.
Offsets refer to the tokenizer's normal form of the text (NFC, lower case).
Characters that Unicode assigned after version 15.1 are read as unassigned.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.llm.common import prepare_python, list_array, text_chunks
from veritable.llm.pieces import Chunk, byte_chars, special_ids, tokenizer_path

WORD_TOKENIZER = "word_bpe_49k.json"
NEVER = 1 << 62


class PrefixBpe:
    """Token counts at the prefixes of single words."""

    def __init__(self, path: str, cache: int = 400_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.merge = {tuple(pair): r for r, pair in enumerate(model["merges"])}
        self.made = {}  # token -> (left part, right part, rank)
        for (a, b), r in self.merge.items():
            if self.made.setdefault(a + b, (a, b, r))[2] != r:
                raise ValueError("a token is made by two merges")
        for a, b, r in self.made.values():
            if max(self.made.get(a, (0, 0, -1))[2], self.made.get(b, (0, 0, -1))[2]) > r:
                raise ValueError("a merge comes before the merges of its parts")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.edges: dict[tuple[str, int], list[tuple[str, int]]] = {}
        self.tokens = {t for t in model["vocab"] if self._whole(t)}
        self.longest = max(map(len, self.tokens))
        self.size, self.known = cache, {}

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The symbols that stand at one end of a token while it grows, each with the rank of the merge that ends it."""
        out = self.edges.get((token, side))
        if out is None:
            out, until, t = [], NEVER, token
            while True:
                out.append((t, until))
                if t not in self.made:
                    break
                until, t = self.made[t][2], self.made[t][side]
            out.reverse()
            self.edges[token, side] = out
        return out

    def _apart(self, a: str, b: str, joined: bool = False) -> bool:
        """True if BPE grows ``a`` and ``b`` side by side without a merge across; ``joined``: but for the last one."""
        left, right, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            across = self.merge.get((x, y), NEVER)
            if x_until == NEVER and y_until == NEVER:
                return joined or across == NEVER
            if across < x_until and across <= y_until:  # of equal merges, the one further left goes first
                return False
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def follows(self, a: str, b: str) -> bool:
        out = self.pairs.get((a, b))
        if out is None:
            out = self._apart(a, b)
            if len(self.pairs) < 2_000_000:
                self.pairs[a, b] = out
        return out

    def _whole(self, token: str) -> bool:
        """Whether BPE makes this token of its own symbols."""
        if token not in self.made:
            return True
        a, b, _ = self.made[token]
        return self._whole(a) and self._whole(b) and self._apart(a, b, joined=True)

    def prefixes(self, word: str, last: list[str] | None = None, n: list[int] | None = None, known: int = 0):
        """(last tokens, counts) of the open prefixes of a word in the byte-level alphabet; the first ``known`` are given."""
        last = [""] if last is None else last[: known + 1]
        n = [0] if n is None else n[: known + 1]
        for i in range(len(last), len(word) + 1):
            for j in range(max(0, i - self.longest), i):
                t = word[j:i]
                if t in self.tokens and (not j or self.follows(last[j], t)):
                    last.append(t)
                    n.append(n[j] + 1)
                    break
            else:
                raise ValueError(f"no token ends a prefix of {word!r}")
        return last, n

    def closed(self, word: str, last: list[str], n: list[int], i: int) -> int:
        """Tokens of the word cut after ``i`` symbols, from the open prefixes before."""
        if not i:
            return 0
        for j in range(max(0, i - self.longest), i):
            t = word[j:i] + self.end
            if t in self.tokens and (not j or self.follows(last[j], t)):
                return n[j] + 1
        raise ValueError(f"no token ends {word!r}")

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each whole word. In sorted order, a word starts from the prefixes it shares with the one before."""
        out = np.zeros(len(words), np.int64)
        last, n, before = [""], [0], ""
        for k in sorted(range(len(words)), key=words.__getitem__):
            got = self.known.get(words[k])
            if got is None:
                word = byte_chars(words[k])
                shared = 0
                for a, b in zip(before, word, strict=False):
                    if a != b:
                        break
                    shared += 1
                shared = min(shared, len(last) - 1)
                last, n = self.prefixes(word[:-1], last, n, min(shared, len(word) - 1))
                before = word
                got = self.closed(word, last, n, len(word))
                if len(self.known) < self.size:
                    self.known[words[k]] = got
            out[k] = got
        return out

    def cut(self, word: bytes, budget: int) -> int:
        """The most characters of a word whose closed prefix has at most ``budget`` tokens."""
        text = word.decode("utf-8")
        symbols = byte_chars(word)
        last, n = self.prefixes(symbols)
        at, best = 0, 0
        for k, ch in enumerate(text, 1):
            at += len(ch.encode())
            if self.closed(symbols, last, n, at) <= budget:
                best = k
        return best


@functools.lru_cache(maxsize=2)
def prefix_bpe(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def _counted(ids, texts, path) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, tokens of each pre-token, first pre-token of each text, tokens of each text)."""
    bpe = prefix_bpe(path)
    chunk = Chunk([t or "" for t in texts], "word", special_ids(path))
    words = chunk.words.to_pylist()
    special = {chunk.code[i] for i in np.flatnonzero(chunk.special)}
    plain = [i for i in range(len(words)) if i not in special]
    size = np.ones(len(words), np.int64)
    size[plain] = bpe.counts([words[i] for i in plain])
    each = size[chunk.code] if len(chunk.code) else np.empty(0, np.int64)
    first = np.searchsorted(chunk.doc, np.arange(len(texts) + 1))
    return chunk, each, first, chunk.per_doc(each)


def prefix_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: ``doc_id``, ``n_tokens``, ``stops`` and ``counts``.

    ``counts[i]`` is the exact number of tokens of the text cut after code
    point ``stops[i]`` (the end of its i-th pre-token); between two stops only
    the cut word differs (``PrefixBpe.closed``). Ask with ``count_at`` and
    ``stop_within``.
    """
    prepare_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches, "id", "text"):
            chunk, each, first, total = _counted(ids, texts, path)
            running = np.cumsum(each) - np.repeat((np.cumsum(total) - total), np.diff(first))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(total), list_array(chunk.stop, np.diff(first), pa.int32()),
                 list_array(running, np.diff(first), pa.int32())], ["doc_id", "n_tokens", "stops", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, stops array<int>, counts array<int>")


def count_at(stop: Column | int) -> Column:
    """Tokens of the prefix that ends at the last pre-token end at or before ``stop`` (on a ``prefix_table``)."""
    stop = stop if isinstance(stop, Column) else F.lit(stop)
    n = F.size(F.filter("stops", lambda x: x <= stop))
    return F.when(n > 0, F.element_at("counts", n)).otherwise(0)


def stop_within(budget: Column | int) -> Column:
    """The last pre-token end whose prefix has at most ``budget`` tokens (on a ``prefix_table``; 0: none)."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    n = F.size(F.filter("counts", lambda x: x <= budget))
    return F.when(n > 0, F.element_at("stops", n)).otherwise(0)


def token_budget(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, cut``: exact size of each text against a budget.

    ``cut`` is how many code points of the text's normal form fit into
    ``limit`` tokens, to the character: it is read off the prefix counts of
    the words and, in the word where the budget runs out, of its letters.
    """
    prepare_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = prefix_bpe(path)
        for ids, texts in text_chunks(batches, "id", "text"):
            chunk, each, first, total = _counted(ids, texts, path)
            cuts = np.array([chunk.stop[b - 1] if b > a else 0 for a, b in zip(first[:-1], first[1:], strict=True)],
                            np.int64)
            for k in np.flatnonzero(total > limit):
                a, b = first[k], first[k + 1]
                upto = np.cumsum(each[a:b])
                i = int(np.searchsorted(upto, limit, "right"))  # the word in which the budget runs out
                left = limit - (int(upto[i - 1]) if i else 0)
                word = chunk.words[int(chunk.code[a + i])].as_py()
                inside = 0 if chunk.special[a + i] else bpe.cut(word, left)
                cuts[k] = int(chunk.start[a + i]) + inside if inside else (int(chunk.stop[a + i - 1]) if i else 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                 pa.array(total), pa.array(total > limit), pa.array(cuts)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut long")


def default_path() -> str:
    return tokenizer_path(WORD_TOKENIZER)
