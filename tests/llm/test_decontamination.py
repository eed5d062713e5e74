"""Operator 13 against windows looked up one by one."""

import hashlib
import random

import pytest

from veritable.llm import decontaminate


def brute(docs, items, window=10):
    runs = {}
    for i, t in items:
        words = decontaminate.words_of(t)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            runs.setdefault(tuple(words[k:k + size]), set()).add(i)
    out = []
    for doc, t in docs:
        words, hit, found = decontaminate.words_of(t), set(), set()
        for size in {len(r) for r in runs}:
            for k in range(len(words) - size + 1):
                own = runs.get(tuple(words[k:k + size]))
                if own is not None:
                    hit |= set(range(k, k + size))
                    found |= own
        listed = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(words), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(12)]
    run = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, run(rng.choice([3, 9, 10, 11, 25, 60]))) for i in range(40)]
    passage = items[3][1] + " " + items[7][1]
    items += [(100, passage), (101, passage), (102, None), (103, ""), (104, "?!"), (None, run(14)), (3, run(30)), (105, "Ünï-CODE  x2;日本 语 a b c d e f g")]
    docs = [(i, run(rng.choice([0, 2, 30, 200]))) for i in range(150)]
    docs += [(200 + i, run(20) + ", " + items[k][1].upper() + "! " + run(5)) for i, k in enumerate(range(len(items))) if items[k][1]]
    docs += [(400 + i, passage) for i in range(60)]  # one common passage
    docs += [(500, None), (501, ""), (502, " ,. "), (None, passage), (None, "a"), (503, "ünï code X2 日本 语 a b c d e f g"), (503, "ünï code X2 日本 语 a b c d e f g"),
             (504, "x" * 50_000), (505, run(30_000) + " " + passage), (506, "w0 w1")]
    return docs, items


@pytest.fixture(scope="module")
def bench(spark, corpus):
    rows = [(i, t, 1, "x") for i, t in corpus[1]]
    return spark.createDataFrame(rows + rows[:5], "item_id long, text string, id int, key string").repartition(3)


def test_against_brute_force(spark, docs, corpus, bench):
    assert result(decontaminate.contamination(docs(corpus[0]), bench)) == brute(*corpus)


def test_long_windows_only(spark, docs, corpus):
    """Without short items the groups of four words let most text be skipped."""
    items = [x for x in corpus[1] if len(decontaminate.words_of(x[1])) >= 10]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window in (10, 5, 1):
        assert result(decontaminate.contamination(docs(corpus[0]), bench, window)) == brute(corpus[0], items, window)


def test_several_automata(spark, docs, corpus, bench, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_WORDS", 20)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 250)
    assert decontaminate.automata(bench).count() > 3
    assert result(decontaminate.contamination(docs(corpus[0]), bench)) == brute(*corpus)


def test_longest_match():
    item = [b"a", b"b", b"a", b"b", b"c", b"a", b"b"]
    automaton = decontaminate.Automaton([(1, item), (2, [b"b", b"c", b"d", b"a"])], 4)
    n, spans, items, longest = automaton.scan(b"z a b c a b q a b a b c a b z b c d a")
    assert (n, spans, items, longest) == (19, [(1, 6), (7, 14), (15, 19)], {1, 2}, 7)
    assert automaton.scan(b"") == automaton.scan(b"   ") == (0, [], set(), 0)


def test_empty_tables(spark, docs, corpus, bench):
    none = bench.where("false")
    assert result(decontaminate.contamination(docs(corpus[0][:30]), none)) == brute(corpus[0][:30], [])
    assert decontaminate.contamination(docs([(1, "x")]).where("false"), bench).collect() == []


def test_cut(spark, docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "a b c")], "item_id long, text string")
    passage = "One, two three four FIVE six seven eight nine (ten) eleven"
    rows = [(1, "Before it. " + "x " * 40 + passage + " After é it."), (2, passage), (3, "keep a b c " + "y " * 9), (4, None), (5, "")]
    got = {r.doc_id: r for r in decontaminate.decontaminated(docs(rows), bench).collect()}
    assert sorted(got) == [1, 3, 4, 5]
    assert got[1].text == "Before it. " + "x " * 40 + " After é it." and got[1].n_cut == got[1].n_hit == 11
    assert got[3].text == rows[2][1] and got[3].n_hit == 3 and got[3].n_cut == 0  # below the least span
    assert got[4].text is None and got[5].text == ""
