"""Operator 13: benchmark decontamination by a generalised suffix automaton.

Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z
lower-cased. The words of all test items are read into one suffix automaton,
whose states are the sets of runs of words that end at the same places of the
items. A document's words are streamed through it; after each word the state
gives the longest run of words up to there that any item holds, and with the
states above it (suffix links) the windows that end there: runs of ``window``
item words, and items shorter than that as a whole. Their words are hit.

Streaming skips what cannot match: a match of the least window's length is a
chain of item word groups (four words, or fewer if the least window is
shorter), and only such chains go through the automaton word by word.

An automaton is sent to all tasks, so it is bounded: items are cut into parts
of at most ``PART_WORDS`` words, overlapping by a window less one word, the
parts are dealt to automata of at most ``SHARD_WORDS`` words, each is built in
a task of its own, and the documents are read once for each. What one text's
passes find is united, so the automata together find what one would.

Edge cases: a null or empty text, and one without words, has no words and no
hit. A null or wordless item has no window; an item row without an id hits
words but is not counted or listed. Items that share an id are one item.
Repeated document rows are returned as often, null ids are kept. Without items
nothing is hit. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.llm.common import prepare_python, shared_table

#: Words of one part of an item, and of one automaton.
PART_WORDS, SHARD_WORDS = 2_000, 100_000
#: Words in the groups that let most text be skipped, and bytes of text whose words are held at a time.
GROUP, SLICE = 4, 1 << 20

#: Word bytes map to themselves (A-Z to a-z), all others to a blank.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, with the windows that end in each state.

    ``step``: (state * vocabulary size + word) -> state. ``link``: the state of
    the longest suffix that ends at more places. ``length``: of a state's longest
    run. ``own``: state -> [(window length, items)], longest first. ``above``:
    the next state up the links that has windows.
    """

    def __init__(self, parts: list[tuple[int | None, list[bytes]]], window: int):
        self.word: dict[bytes, int] = {}
        rows = [(item, [self.word.setdefault(w, len(self.word)) for w in words]) for item, words in parts]
        self.n = max(1, len(self.word))
        self.step: dict[int, int] = {}
        self.out: list[list[int]] = [[]]
        self.link, self.length = [-1], [0]
        for _, own in rows:
            last = 0
            for w in own:
                last = self._extend(last, w)
        found: dict[int, dict[int, set]] = {}
        for item, own in rows:
            for size, state in self._window_states(own, window):
                found.setdefault(state, {}).setdefault(size, set()).add(item)
        self.own = {s: [(size, sorted(x for x in items if x is not None)) for size, items in sorted(by.items(), reverse=True)] for s, by in found.items()}
        self.above = [-1] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            self.above[s] = up if up in self.own else self.above[up]
        self.least = min((size for by in self.own.values() for size, _ in by), default=0)
        self.group = min(GROUP, self.least)
        del self.out
        grams = {tuple(own[i:i + self.group]) for _, own in rows for i in range(len(own) - self.group + 1)} if self.least else set()
        self.mask = (1 << max(16, (16 * len(grams)).bit_length())) - 1
        self.known = np.zeros(self.mask + 1, bool)
        if grams:
            self.known[self._spread(np.array(sorted(grams), np.int64).T)] = True

    def _new(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.out.append([])
        return len(self.link) - 1

    def _put(self, state: int, w: int, to: int) -> None:
        key = state * self.n + w
        if key not in self.step:
            self.out[state].append(w)
        self.step[key] = to

    def _split(self, p: int, w: int, q: int) -> int:
        """A state for the runs of q that end at p's places: q's shorter ones."""
        copy = self._new(self.length[p] + 1, self.link[q])
        for x in self.out[q]:
            self._put(copy, x, self.step[q * self.n + x])
        self.link[q] = copy
        while p >= 0 and self.step.get(p * self.n + w) == q:
            self.step[p * self.n + w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.step.get(last * self.n + w)
        if q is not None:  # an earlier sequence has this run
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._new(self.length[last] + 1, 0), last
        while p >= 0 and p * self.n + w not in self.step:
            self._put(p, w, new)
            p = self.link[p]
        if p >= 0:
            q = self.step[p * self.n + w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _window_states(self, own: list[int], window: int) -> Iterator[tuple[int, int]]:
        size, state = min(window, len(own)), 0
        for at, w in enumerate(own, 1):
            state = self.step[state * self.n + w]
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            if at >= size:
                yield size, state

    def _spread(self, columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.int64)
        for c in columns:
            h = (h * 1_000_003 + c + 1) & 0x7FFFFFFFFFFF
        return (h ^ h >> 21) & self.mask

    def word_ids(self, folded: bytes) -> np.ndarray:
        """Vocabulary numbers of a folded text's words, -1 for words that no item has."""
        get, out, at = self.word.get, [], 0
        while at < len(folded):
            stop = folded.find(b" ", at + SLICE)
            stop = len(folded) if stop < 0 else stop
            own = folded[at:stop].split()
            out.append(np.fromiter([get(w, -1) for w in own], np.int64, len(own)))
            at = stop
        return np.concatenate(out) if len(out) != 1 else out[0]

    def chains(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words outside of which no window can lie."""
        n = len(ids) - self.group + 1
        if not self.least or n <= self.least - self.group:
            return []
        here = ids >= 0
        if np.count_nonzero(here) < self.least:
            return []
        columns = [ids[i:i + n] for i in range(self.group)]
        fits = self.known[self._spread(columns)]
        for i in range(self.group):
            fits &= here[i:i + n]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], fits, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.least - self.group + 1
        return list(zip(starts[long].tolist(), (ends[long] + self.group - 1).tolist(), strict=True))

    def scan(self, folded: bytes) -> tuple[int, list[tuple[int, int]], set, int]:
        """(words, hit spans in words, items, longest match) of a text; a match counts from the least window on."""
        if not folded or folded.isspace():
            return 0, [], set(), 0
        ids = self.word_ids(folded)
        cover, ends, longest = [], set(), 0
        n, step, link, length, own, above, least = self.n, self.step, self.link, self.length, self.own, self.above, self.least
        for a, b in self.chains(ids):
            state = run = 0
            for at, w in enumerate(ids[a:b].tolist(), a + 1):
                to = step.get(state * n + w)
                while to is None and state:
                    state = link[state]
                    run = length[state]
                    to = step.get(state * n + w)
                if to is None:
                    continue
                state, run = to, run + 1
                if run < least:
                    continue
                longest = max(longest, run)
                widest, up = 0, state
                while up > 0:
                    for size, _ in own.get(up, ()):
                        if size <= run:
                            widest = max(widest, size)
                            ends.add((up, size))
                    up = above[up]
                if widest:
                    cover.append((at - widest, at))
        items: set = set()
        for state, size in ends:
            for width, listed in own[state]:
                if width == size:
                    items.update(listed)
        return len(ids), united(cover), items, longest


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_parts(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct (item, part) rows: an item's words joined by blanks, long items in overlapping parts."""

    size = max(PART_WORDS, 2 * window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = [], []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words, at = words_of(t), 0
                while at == 0 and words or at + window <= len(words):
                    ids.append(i)
                    parts.append(b" ".join(words[at:at + size]))
                    if at + size >= len(words):
                        break
                    at += size - window + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.binary()), pa.array([1 + p.count(b" ") for p in parts], pa.int64())],
                                             ["item", "part", "words"])

    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "item long, part binary, words long").distinct()


def automata(items: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(shard, automaton): pickled automata of at most ``SHARD_WORDS`` words each, built one a task group."""
    prepare_python(items.sparkSession)
    parts = shared_table(item_parts(items, window, id_col, text_col), "parts")
    total = parts.agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    while True:  # the even spread of a hash, checked
        dealt = parts.withColumn("shard", F.pmod(F.xxhash64("item", "part"), F.lit(shards)))
        most = dealt.groupBy("shard").agg(F.sum("words").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= max(SHARD_WORDS, PART_WORDS, 2 * window):
            break
        shards *= 2

    def build(group: pa.Table) -> pa.Table:
        rows = [(i, p.split()) for i, p in zip(group.column("item").to_pylist(), group.column("part").to_pylist(), strict=True)]
        return pa.table({"shard": group.column("shard").slice(0, 1), "automaton": pa.array([pickle.dumps(Automaton(rows, window))], pa.binary())})

    return shared_table(dealt.groupBy("shard").applyInArrow(build, "shard long, automaton binary"), "automata")


SPANS = "array<struct<start:long,stop:long>>"


def _pass(rows: DataFrame, blob: bytes, every: bool) -> DataFrame:
    """Each row's words, spans, items and longest match by one automaton; without ``every`` only rows with a hit."""
    sent = rows.sparkSession.sparkContext.broadcast(blob)  # at most SHARD_WORDS words: see the module text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = pickle.loads(sent.value)
        for batch in batches:
            n_words, spans, items, longest = [], [], [], []
            for t in batch.column("text").to_pylist():
                n, cover, found, most = automaton.scan(t.encode().translate(FOLD) if t else b"")
                n_words.append(n)
                spans.append([{"start": a, "stop": b} for a, b in cover])
                items.append(sorted(found))
                longest.append(most)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            out = pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.int64())), pa.array(longest, pa.int64())],
                [*batch.schema.names, "n_words", "spans", "items", "longest"])
            yield out if every else out.filter(pa.array([bool(s) for s in spans], pa.bool_()))

    return rows.mapInArrow(run, f"id long, key long, text string, n_words long, spans {SPANS}, items array<long>, longest long")


def _merged(group: pa.Table) -> pa.Table:
    """What the automata found in one text, united."""
    spans = united([(s["start"], s["stop"]) for own in group.column("spans").to_pylist() for s in own])
    items = sorted({x for own in group.column("items").to_pylist() for x in own})
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.table({"id": group.column("id").slice(0, 1), "key": group.column("key").slice(0, 1),
                     "spans": pa.array([[{"start": a, "stop": b} for a, b in spans]], kind),
                     "items": pa.array([items], pa.list_(pa.int64())), "longest": pa.array([max(group.column("longest").to_pylist())], pa.int64())})


def matches(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id, text, n_words, spans, items, longest`` of every document row; spans count words, their stop is exclusive."""
    spark = docs.sparkSession
    prepare_python(spark)
    held = automata(items, window, item_col, item_text_col)
    shards = [r[0] for r in held.select("shard").orderBy("shard").collect()]  # one number an automaton
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"),
                       F.col(text_col).cast("string").alias("text"))
    blobs = (held.where(F.col("shard") == s).first()["automaton"] for s in shards)
    first = _pass(rows, next(blobs, pickle.dumps(Automaton([], window))), True)
    if len(shards) < 2:
        return first.drop("key")
    first = shared_table(first, "hits")
    found = first.where("size(spans) > 0").drop("text", "n_words")
    for blob in blobs:  # one at a time: a pass is written before the next automaton is read
        found = found.unionByName(shared_table(_pass(rows, blob, False).drop("text", "n_words"), "hits"))
    # One text's rows: at most one an automaton, and repeats of a row, which find the same.
    found = found.dropDuplicates(["id", "key", "spans", "items"])
    merged = found.groupBy("id", "key").applyInArrow(_merged, f"id long, key long, spans {SPANS}, items array<long>, longest long")
    m = merged.select(F.col("id").alias("m_id"), F.col("key").alias("m_key"), F.col("spans").alias("m_spans"), F.col("items").alias("m_items"), F.col("longest").alias("m_longest"))
    both = first.join(m, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("key") == F.col("m_key")), "left")
    none = F.array().cast(SPANS), F.array().cast("array<long>")
    return both.select("id", "text", "n_words", F.coalesce("m_spans", none[0]).alias("spans"), F.coalesce("m_items", none[1]).alias("items"),
                       F.coalesce("m_longest", F.lit(0).cast("long")).alias("longest"))


def _hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, **columns: str) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest`` of every document row."""
    found = matches(docs, items, window, **columns)
    listed = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", _hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(listed, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "longest")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the bytes from the first to the last word of each span."""
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done:places[a][0]])
        done = places[b - 1][1]
    return b"".join([*out, raw[done:]]).decode()


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10, least_span: int = 10, most_share: float = 0.5, **columns: str) -> DataFrame:
    """``doc_id, text, n_words, n_hit, n_cut`` of the documents that stay.

    Hit spans of ``least_span`` words or more are cut out; a document with more
    than ``most_share`` of its words hit goes as a whole.
    """
    found = matches(docs, items, window, **columns).withColumn("n_hit", _hit())
    kept = found.where((F.col("n_words") == 0) | (F.col("n_hit") <= most_share * F.col("n_words")))
    kept = kept.withColumn("cut", F.filter("spans", lambda s: s["stop"] - s["start"] >= least_span))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_words(t, [(s["start"], s["stop"]) for s in cut]) if cut else t
                     for t, cut in zip(batch.column("text").to_pylist(), batch.column("cut").to_pylist(), strict=True)]
            n_cut = [sum(s["stop"] - s["start"] for s in cut) for cut in batch.column("cut").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), batch.column("n_words"), batch.column("n_hit"), pa.array(n_cut, pa.int64())],
                                             ["doc_id", "text", "n_words", "n_hit", "n_cut"])

    return kept.select("id", "text", "n_words", "n_hit", "cut").mapInArrow(run, "doc_id long, text string, n_words long, n_hit long, n_cut long")
