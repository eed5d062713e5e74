"""The pipeline: every stage's decisions, and the whole run on a driver table."""

import re

import corpus_pipeline
import __spark_entry__ as entry
from veritable.llm import line_dedup, packing, pieces


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))


def test_stages_take_effect(spark, docs):
    body = ["The first line of the document is long enough to count for this.", "Here is a second line with other words in it, too.",
            "And a third one that says something else again, at some length."]
    rows = [(k, f"{body[0]} {k * 7} {body[1]} {k} {body[2]} " + " ".join(f"t{k}x{i}" for i in range(40)), "en") for k in range(1, 30)]
    shared = "This line is found in two of the documents, so one of them loses it."
    near = " ".join(f"common{i}" for i in range(90))
    rows += [(50, f"{shared}\nfirst own words of number fifty are these", "en"),
             (51, f"{shared}\nthe other document has its own line, like so", "en"), (52, shared, "en"),
             (60, near + " end one", "en"), (61, near.replace("common45", "x45") + " end two", "en"),
             (70, "my password: abcdefgh12345 is in here with words around it", "en"), (80, None, "en"), (81, "12 34", "en")]
    frame = docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    state, seen = frame, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, "")
        assert state.columns == frame.columns and state.dtypes == frame.dtypes
        seen[name] = {r.doc_id: r for r in state.collect()}
        assert all(r.n_chars == len(r.text) for r in seen[name].values())
        state = spark.createDataFrame(list(seen[name].values()), frame.schema)
    assert set(seen["language_id"]) == {r[0] for r in rows} - {80, 81}
    assert set(seen["line_dedup"]) == set(seen["language_id"]) - {52, 61}
    assert shared in seen["line_dedup"][50].text and shared not in seen["line_dedup"][51].text
    assert "abcdefgh12345" not in seen["secret_scan"][70].text and "[secret]" in seen["secret_scan"][70].text
    packed = corpus_pipeline.pack(spark, state, "").collect()
    assert {r.doc_id for r in packed} == set(seen["secret_scan"])


def test_near_duplicate_stage(spark, docs):
    near = " ".join(f"common{i}" for i in range(90))
    frame = docs([(60, near), (61, near.replace("common45", "x45")), (62, "quite another text than the two")])
    out = corpus_pipeline.near_duplicates(spark, frame, "")
    assert sorted(r.doc_id for r in out.collect()) == [60, 62]


def test_whole_run(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf).collect()
    tokenizer = pieces.tokenizer(packing.default_path())
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in got} <= set(source)
    # Plain tokens of each document bound what is packed of it.
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    mark = len(tokenizer.encode("[secret]").ids)
    for k, n in total.items():
        lines = len(source[k].split("\n"))
        assert n <= len(tokenizer.encode(source[k]).ids) + 1 + mark * 20 + lines
    # Every distinct line of clean documents is still in some document, or is near a line that is.
    assert len(total) >= 0.5 * len({re.sub(r"\s+", " ", t) for t in source.values()})
    assert line_dedup.LEAST > 0


def test_language_decides_what_follows(spark, docs):
    """Languages found, not labels, part the sequences; texts in none of them go."""
    words = {"aa": "kala mano tiru sene kolo maka lano", "bb": "grox zwift plunk brast vlimp skrent drogg"}
    line = lambda lang, k: " ".join(words[lang].split()[(k * i + i // 3) % 7] for i in range(1, 20))
    rows = [(k, line(lang, k), lang) for k in range(60) for lang in [("aa", "bb")[k % 2]]]
    rows += [(200, line("aa", 5), None), (201, line("bb", 4), "aa"), (202, "漢字仮名交文書語言學習測試" * 8, None)]
    frame = docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    found = corpus_pipeline.language_id(spark, frame, "")
    assert found.schema == frame.schema
    lang = {r.doc_id: r.lang for r in found.collect()}
    assert lang == {k: "aa" if t.split()[0] in words["aa"] else "bb" for k, t, _ in rows if k != 202}
    packed = corpus_pipeline.pack(spark, found, "").collect()
    assert sorted(r.doc_id for r in packed) == sorted(lang)
    held = {}
    for r in packed:
        assert r.lang == lang[r.doc_id]
        held.setdefault(r.sequence_id, set()).add(r.lang)
    assert all(len(x) == 1 for x in held.values()) and {y for x in held.values() for y in x} == {"aa", "bb"}
    for k in held:
        own = sorted((r.offset, r.length) for r in packed if r.sequence_id == k)
        assert all(a + n == b for (a, n), (b, _) in zip(own[:-1], own[1:], strict=True)) and own[0][0] == 0
