"""Operators 5 and 9 and the components they share, against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritable.llm import line_dedup, meet, ngram_join
from veritable.llm.common import connected_components


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200, 260)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(70)]
    edges += [(300, k) for k in range(301, 400)] + [(7, None), (500, 500)]
    plain = Union()
    for a, b in edges:
        if b is not None:
            plain.join(a, b)
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == {x: plain.find(x) for x in plain.up}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


# --- n-gram join -------------------------------------------------------------------------------------------------

def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 4]) for i in range(len(words) - 3)} if len(words) > 3 else ({tuple(words)} if words else set())


def plain_join(rows):
    union, sets = Union(), [(k, plain_set(t)) for k, t in rows]
    for k, _ in sets:
        if k is not None:
            union.join(k, k)
    for (a, x), (b, y) in combinations(sets, 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
            union.join(a, b)
    return sorted(((k, len(s), None if k is None else union.find(k)) for k, s in sets), key=str)


def near_copies(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    passage = [rng.choice(words) for _ in range(60)]
    for size in (1, 2, 3, 4, 5, 8, 12, 20, 35, 60, 110, 200, 400):
        for _ in range(3):
            base = [rng.choice(words) for _ in range(size)]
            if size > 60 and rng.random() < 0.7:
                base[5:5] = passage
            for copy in range(rng.randint(1, 7)):
                text = list(base)
                for _ in range(rng.randint(0, max(1, size // 25))):
                    text[rng.randrange(len(text))] = rng.choice(words)
                if copy % 3 == 2:
                    text = text[: max(1, int(len(text) * 0.9))]
                rows.append((k, " ".join(text)))
                k += 1
    rng.shuffle(rows)
    return rows


def checked(docs, rows):
    got = ngram_join.join(docs(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_join(rows)


def test_join_matches_brute_force(docs):
    rows = near_copies()
    found = plain_join(rows)
    assert len({c for _, _, c in found}) < len(rows) - 20  # there is something to find
    checked(docs, rows)


def test_join_edges(docs, edges):
    rows = [*edges, (20, "A b\tC"), (21, "a B c"), (22, "a b c d"), (None, "a b c d"), (23, "é É x y z"), (24, "É É x y z"),
            (11, "another text with the same id as two rows"), (30, "another text with the same id as two rows")]
    checked(docs, rows)
    assert ngram_join.join(docs(rows).where("false")).collect() == []


def test_second_round_finds_links_that_leaders_miss(docs, monkeypatch):
    """Chains, so that most links are not with a key's smallest node; tiny tiles and trees of several levels."""
    monkeypatch.setattr(meet, "TILE", 5)
    monkeypatch.setattr(ngram_join, "FAN", 3)
    rng = random.Random(8)
    rows = []
    for c in range(4):
        text = [f"c{c}v{i}" for i in range(150)]
        for k in range(20):
            rows.append((c * 100 + k, " ".join(text)))
            for _ in range(2):
                text[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
    checked(docs, rows)


def kept_tables(monkeypatch, *names):
    """name -> rows of the tables of those names that ``meet`` writes from now on, in order."""
    seen, write = {name: [] for name in names}, meet.shared_table

    def shared(df, name):
        out = write(df, name)
        if name in seen:
            seen[name].append(out.count())
        return out

    monkeypatch.setattr(meet, "shared_table", shared)
    return seen


def test_groups_below_the_threshold_give_no_pair_a_key(docs, monkeypatch):
    """Two groups whose texts share many keys and are not linked: no row for each pair and key when every pair is asked for."""
    rng = random.Random(4)
    base = [f"v{i}" for i in range(1200)]
    rows = []
    for group in range(2):
        text = [f"g{i}" for i in range(105)] + base[105:] if group else list(base)
        for k in range(7):
            own = list(text)
            own[rng.randrange(200, 1200)] = f"n{rng.randrange(10**6)}"
            rows.append((group * 100 + k, " ".join(own)))
    seen = kept_tables(monkeypatch, "met")
    checked(docs, rows)
    assert len(seen["met"]) == 2 and seen["met"][1] <= 7 * 7


def test_one_of_the_keys_that_hold_the_same_nodes(spark):
    rows = [(k, n, 1, 1) for k in (5, 3, 9) for n in (1, 2, 3)] + [(4, n, 1, 1) for n in (1, 2)] + [(6, n, 1, 1) for n in (1, 4)]
    got = meet._one_key_a_set(spark.createDataFrame(rows, "key long, node long, low long, comp long")).collect()
    assert sorted((r.key, r.node) for r in got) == [(3, 1), (3, 2), (3, 3), (4, 1), (4, 2), (6, 1), (6, 4)]


@pytest.mark.parametrize("groups", [ngram_join.DIMENSIONS, ngram_join.FINE])
def test_screen_keeps_every_linked_pair_of_two_components(groups):
    rng = np.random.default_rng(9)
    whole = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(whole)[int(rng.integers(0, 60)):],
                                      rng.integers(0, 2**63, int(rng.integers(0, 30))).astype(np.uint64)])) for _ in range(40)]
    sizes, comp = np.array([len(s) for s in sets]), rng.integers(0, 4, 40)
    points = np.stack([ngram_join.point(s, groups) for s in sets])
    side = np.arange(40) % 2
    for same in (True, False):
        i, j, _ = ngram_join.screen(sizes, comp, side, points, same)
        got = {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
        assert all(comp[a] != comp[b] and (same or side[a] != side[b]) for a, b in got) and len(got) == len(i)
        for a, b in combinations(range(40), 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            if comp[a] != comp[b] and (same or side[a] != side[b]) and 100 * both >= 85 * (sizes[a] + sizes[b] - both):
                assert (a, b) in got


def test_every_linked_pair_shares_a_key():
    rng = np.random.default_rng(5)
    bands = ngram_join.Bands()
    for size in [*range(1, 60), 100, 333, 1000]:
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        for _ in range(6):
            cut = int(rng.integers(0, max(1, int(0.12 * len(a))) + 1))
            extra = rng.integers(0, 2**63, int(rng.integers(0, max(1, int(0.12 * len(a))) + 1))).astype(np.uint64)
            b = np.unique(np.concatenate([rng.permutation(a)[cut:], extra]))
            both = len(np.intersect1d(a, b))
            if 0 < both < max(len(a), len(b)) and 100 * both >= 85 * (len(a) + len(b) - both):
                assert len(np.intersect1d(bands.keys(a), bands.keys(b))), (len(a), len(b), both)


def test_tree_search_is_exact():
    rng = np.random.default_rng(6)
    points = rng.poisson(3, (300, 8)).astype(np.int64)
    points[100:150] = points[0] + rng.poisson(0.1, (50, 8))
    sizes = points.sum(axis=1)
    tree = ngram_join.CountRTree(sizes, points)
    for q in range(0, 300, 17):
        ok = [i for i in range(300) if 100 * min(sizes[i], sizes[q]) >= 85 * max(sizes[i], sizes[q])
              and np.minimum(points[i], points[q]).sum() >= ngram_join.needed(sizes[i], sizes[q])]
        assert sorted(tree.search(int(sizes[q]), points[q]).tolist()) == ok


def test_a_text_of_many_shingles(docs):
    size = 5_000_000
    counts = ngram_join.point(np.arange(size, dtype=np.uint64))
    assert counts.sum() == size and counts.max() > np.iinfo(np.int16).max
    text = " ".join(map(str, range(size)))
    got = {r.id: r for r in ngram_join.document_sets(docs([(1, text), (2, "a b c d e")], 1).selectExpr("doc_id AS id", "text"))
           .selectExpr("id", "size", "aggregate(counts, 0L, (s, x) -> s + x) AS total").collect()}
    assert got[1].size == got[1].total == size - 3 and got[2].total == 2


def test_representatives(docs):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (3, text + " more"), (9, "other words that are here alone"), (9, "other words that are here alone"),
            (None, text), (8, None), (7, "")]
    frame = docs(rows)
    out = ngram_join.representatives(frame)
    assert out.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(
        [(3, text + " more"), (9, "other words that are here alone"), (None, text), (8, None), (7, "")], key=str)


# --- line deduplication ------------------------------------------------------------------------------------------

def plain_dedup(rows):
    """(text, dropped) of every row by all pairs of lines."""
    norm = line_dedup.normal
    union, where = Union(), {}
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0))
    for k, t in order:
        for i, line in enumerate(t.split("\n")):
            if len(norm(line)) >= line_dedup.LEAST:
                where.setdefault(norm(line), []).append((k, i))
                union.join(norm(line), norm(line))
    sets = {x: line_dedup.shingles(x) for x in where}
    for x, y in combinations(where, 2):
        both = len(sets[x] & sets[y])
        if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
            union.join(x, y)
    first = {}
    for x, places in where.items():
        key = lambda p: (p[0] is None, p[0] or 0, p[1])
        root = union.find(x)
        first[root] = min([first[root], *places], key=key) if root in first else min(places, key=key)
    out = []
    for k, t in rows:
        lines = [] if t is None else t.split("\n")
        keep = [x for i, x in enumerate(lines) if len(norm(x)) < line_dedup.LEAST or first[union.find(norm(x))] == (k, i)]
        out.append((k, None if t is None else "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(12)
    words = [f"word{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 40))) for _ in range(25)]
    rows = []
    for k in range(40):
        lines = []
        for _ in range(rng.randint(1, 6)):
            own = rng.choice(base).split() if rng.random() < 0.7 else [rng.choice(words) for _ in range(20)]
            if rng.random() < 0.5:
                own[rng.randrange(len(own))] = rng.choice(words)
            lines.append((" " * rng.randint(0, 2)).join([""]) + " ".join(own).title() if rng.random() < 0.3 else " ".join(own))
        lines += ["Short.", ""] if rng.random() < 0.4 else []
        rows.append((k, "\n".join(lines)))
    return rows


def test_dedup_matches_brute_force(docs):
    rows = [*line_rows(), (100, None), (101, ""), (102, "\n\n"), (None, "A line without any id is the last of all\nx"),
            (103, "A line  without any ID is the last of all"), (104, "long words " * 9_000)]
    frame = docs(rows)
    got = line_dedup.dedup_lines(frame)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == plain_dedup(rows)
    assert set(frame.columns) < set(got.columns)


def test_one_line_of_a_large_group_stays(docs):
    text = "the very same line of text in every single document"
    rows = [(k, f"{text}\nown line number {k} of the document {k * 7919}") for k in range(80)]
    got = line_dedup.dedup_lines(docs(rows)).collect()
    assert sum(text in r.text for r in got) == 1 and [r.doc_id for r in got if text in r.text] == [0]


def test_repeated_rows_and_empty_table(docs):
    text = "a line that is long enough to count\nand another one which is long enough"
    got = line_dedup.dedup_lines(docs([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(1, 0), (1, 0), (2, 2)]
    assert line_dedup.dedup_lines(docs([(1, text)]).where("false")).collect() == []


def test_linked_lines_share_a_band():
    rng = random.Random(1)
    missed = n = 0
    for _ in range(200):
        a = "".join(rng.choice("abcdefgh ") for _ in range(200))
        b = a[:90] + "#" * 8 + a[98:]
        x, y = line_dedup.band_keys(line_dedup.signatures([a, b]))
        p, q = line_dedup.shingles(a), line_dedup.shingles(b)
        if len(p & q) >= 0.8 * len(p | q):
            n += 1
            missed += not (x == y).any()
    assert n > 100 and missed <= 0.02 * n


def test_pairs_of_lines_are_weighed_as_their_sets():
    rng = random.Random(6)
    line = lambda n: "".join(rng.choice("abé😀 ") for _ in range(n))
    left = [line(rng.randint(20, 300)) for _ in range(400)] + ["a" * 20, "ab" * 500]
    right = [x[:len(x) // 2] + line(rng.randint(0, 1 + len(x) // 9)) + x[len(x) // 2:] for x in left[:-2]] + ["a" * 90, "ba" * 400]
    plain = [line_dedup.alike(line_dedup.shingles(x), line_dedup.shingles(y)) for x, y in zip(left, right, strict=True)]
    assert line_dedup.alike_pairs(left, right).tolist() == plain and 50 < sum(plain) < 380


@pytest.mark.parametrize("n", [1, 12, 200])
def test_lines_of_one_component_are_not_compared(n):
    rng = np.random.default_rng(n)
    points = rng.integers(-2**31, 2**31, (n, 80)).astype(np.int32)
    points[n // 2:] = points[:n - n // 2]
    points[n // 2:, :28] += rng.integers(0, 2, (n - n // 2, 28)).astype(np.int32)
    comp, side, sizes = rng.choice([0, 0, 0, 1, 2], n), rng.integers(0, 2, n), np.ones(n, np.int64)
    for same in (True, False):
        i, j, agree = line_dedup.screen(sizes, comp, side, points, same)
        got = sorted((min(a, b), max(a, b), m) for a, b, m in zip(i.tolist(), j.tolist(), agree.tolist(), strict=True))
        plain = [(a, b, int((points[a] == points[b]).sum())) for a, b in combinations(range(n), 2)
                 if comp[a] != comp[b] and (same or side[a] != side[b])]
        assert got == [p for p in plain if p[2] >= line_dedup.AGREE]


def test_normal_form_of_odd_white_space():
    for x in (" a  B ", "a\tb", "a\u3000B", "A b\u2028", "\x1fa", "a\u200bb", "İ  Σ", "", " ", "\xa0", "plain Line"):
        assert line_dedup.normal(x) == " ".join(x.split()).lower()


def test_texts_of_lines_are_taken_once(docs, monkeypatch):
    calls, own = [], line_dedup.line_texts
    monkeypatch.setattr(line_dedup, "line_texts", lambda rows: calls.append(1) or own(rows))
    seen = kept_tables(monkeypatch, "met")
    rows = line_rows()
    got = line_dedup.dedup_lines(docs(rows)).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=str) == plain_dedup(rows)
    assert len(calls) == 1 and len(seen["met"]) == 1  # the later round took the texts that were held


def test_only_shared_keys_become_rows(docs):
    rows = line_rows()
    frame = docs(rows)
    keys = line_dedup.line_keys(frame.selectExpr("doc_id AS row", "doc_id AS id", "text"))
    got = sorted(map(tuple, keys.distinct().collect()))
    lines = sorted({line for _, text in rows for _, line in line_dedup._lines(text)})
    held = {}
    for line, band in zip(lines, line_dedup.band_keys(line_dedup.signatures(lines)).tolist(), strict=True):
        for key in band:
            held.setdefault(key, set()).add(line_dedup.line_id(line))
    assert got == sorted((key, node) for key, nodes in held.items() if len(nodes) > 1 for node in nodes) and got
    assert line_dedup.dedup_lines(frame).count() == len(rows)


def test_keys_are_shared_over_many_batches(monkeypatch):
    rng = np.random.default_rng(3)
    key, node = rng.integers(0, 900, 5000), rng.integers(0, 60, 5000)
    want = {}
    for k, n in zip(key.tolist(), node.tolist(), strict=True):
        want.setdefault(k, set()).add(n)
    rest, got = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)), []
    for a in range(0, 5000, 250):
        batches, rest = meet._several(rest, [np.stack([key[a:a + 250], node[a:a + 250]], axis=1)])
        got += [x for b in batches for x in zip(b.column("key").to_pylist(), b.column("node").to_pylist(), strict=True)]
        assert len(rest[0]) <= 900  # a row a key, however many nodes it has
    assert set(got) == {(k, n) for k, nodes in want.items() if len(nodes) > 1 for n in nodes}
    monkeypatch.setattr(meet, "PACK", 3)
    packed = meet._packed([(key, node), (-key, node)], 7)
    back = [(p, *map(tuple, np.frombuffer(x, np.int64).reshape(-1, 2).tolist())) for p, x in
            zip(packed.column("part").to_pylist(), packed.column("pairs").to_pylist(), strict=True)]
    assert sorted(y for _, *x in back for y in x) == sorted(zip([*key.tolist(), *(-key).tolist()], [*node.tolist()] * 2, strict=True))
    assert all(k % (1 << 64) % 7 == p and len(x) <= 3 for p, *x in back for k, _ in x)


def test_lines_of_many_pairs_are_weighed_as_their_sets(monkeypatch):
    rng = random.Random(8)
    lines = ["".join(rng.choice("abé😀 ") for _ in range(rng.randint(20, 200))) for _ in range(30)]
    lines += [x[:-3] + "xyz" for x in lines] + [x + x[:9] for x in lines] + ["a" * 20, "a" * 90]
    i, j = np.array(list(combinations(range(len(lines)), 2))).T
    plain = [line_dedup.alike(line_dedup.shingles(lines[a]), line_dedup.shingles(lines[b])) for a, b in zip(i, j, strict=True)]
    for cells in (1 << 22, 1 << 9):
        monkeypatch.setattr(line_dedup, "CELLS", cells)
        assert line_dedup.alike_among(lines, i, j).tolist() == plain and 30 < sum(plain) < 1000


def test_normal_lines_of_whole_texts():
    for x in ("a Line\nAnother ΣΑΣ\nΣ", "ΑΣ\nΑ", "İ x\nb", "a  b\nc", " a\nb", "a \nb", "a\n b", "a\tb\nc", "a\u3000b\nc", "a\r\nb", "\n\n", "a\x1fb", "é\xa0"):
        plain, got = [line_dedup.normal(line) for line in x.split("\n")], line_dedup.normal_lines(x)
        assert got is None or got == plain
    assert line_dedup.normal_lines("A Line\n\nΑΣ\nΑé") == ["a line", "", "ας", "αé"]


@pytest.mark.parametrize("column", ["node", "key", "row"])
def test_clashing_names(docs, column):
    frame = docs([(1, "one line of text that is long enough")]).withColumn(column, F.lit("z"))
    assert line_dedup.dedup_lines(frame).first()[column] == "z"
    assert ngram_join.representatives(frame).first()[column] == "z"
