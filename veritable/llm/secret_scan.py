"""Operator 10: secret scans, in DataFrame functions only.

Three kinds of known shapes are found by pattern: assignments, access keys and
long hexadecimal runs. Spark has no function that gives match positions, so a
text is split by the pattern and the lengths of the gaps and matches are added
up. Strings of unknown shape are found by entropy: over each long run of key
characters a window slides character by character, keeping the sum of
c * log2(c) over its character counts; one step changes only the counts of the
character that leaves and the one that enters. A window whose Shannon entropy
is at least its character class's threshold (hexadecimal digits, or letters and
digits) is part of a span, unless the allow-list covers the run. That is the
rule of the query's SQL; with ``inside``, as the pipeline redacts, a run that the
allow-list matches is not dropped whole: its pieces between placeholders are
looked at without their leading signs. Words joined by signs, dates and UUIDs
are no secrets, what is left is judged by its windows.

Positions are code points, end exclusive. Edge cases: a null text is empty; a
null id and repeated rows are carried through; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the contract: the kinds in their order, each with its pattern, the group measured and its least length.
#: Letters of an assignment's name count in either case.
NAMES = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(_either_case, NAMES)) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
#: A run of characters without its short ones: what such a pattern keeps is found directly, with the same matches.
LONG = {"access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}

WINDOW = 20
#: Bits a character over a window; a random window of 20 has about 3.5 (hexadecimal) and 4.1 (letters and digits).
HEX_BITS, WORD_BITS = 3.05, 3.75
#: Runs of key characters that have a digit, at least as long as a window.
CANDIDATE = "(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
#: Runs that are no secrets: placeholders and examples, paths, UUIDs, dates and words joined by signs.
ALLOW = ("(?i)example|placeholder|changeme|your[_-]?|xxxx|1234567|abcdefg|"
         "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[0-9_/=+-]+$|"
         "^([a-z]+|[0-9]{1,4})([-_/=+]+([a-z]+|[0-9]{1,4}))+$|^[=_/+-]")

#: A segment (letters and digits between signs) with a placeholder in it, one that is no plain word besides, and the others
#: that are as long as a window.
_PLACE = "(?i:example|placeholder|changeme|your|xxxx|1234567|abcdefg)"
PLACEHOLDER = f"(?<![A-Za-z0-9])(?=[A-Za-z0-9]*{_PLACE})[A-Za-z0-9]+"
MIXED = f"(?<![A-Za-z0-9])(?!(?:[a-z]+|[A-Z]+|[A-Z][a-z]+|[0-9]+)(?![A-Za-z0-9]))(?=[A-Za-z0-9]*{_PLACE})[A-Za-z0-9]+"
SEGMENT = f"(?<![A-Za-z0-9])(?![A-Za-z0-9]*{_PLACE})[A-Za-z0-9]{{20,}}"
#: A segment that is neither a word with up to three digits after it nor a number of up to four; and two segments.
NO_WORD = "(?<![A-Za-z0-9])(?!(?:[A-Za-z]*[0-9]{0,3}|[0-9]{4})(?![A-Za-z0-9]))[A-Za-z0-9]"
TWO = "[A-Za-z0-9][=_/+-]+[A-Za-z0-9]"
PLAIN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}[=_/+-]*$|^[0-9_/=+-]*$"


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<at, to, hit>>: the matches of a pattern that never matches nothing, from left to right."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<at:int,to:int,hit:string>>)").alias("out"))

    def step(s, x):
        at = s["at"] + F.length(x["gap"])
        to = at + F.length(x["hit"])
        one = F.struct(at.alias("at"), to.alias("to"), x["hit"].alias("hit"))
        return F.struct(to.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    pairs = F.transform(hits, lambda h, i: F.struct(F.get(gaps, i).alias("gap"), h.alias("hit")))
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda s: s["out"])).otherwise(start["out"])


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind, array<struct<at, to, hit>> of the matches long enough."""
    out = {}
    for kind, pattern, group, least in KINDS:
        found = match_spans(text, LONG.get(kind, pattern))
        if group:
            found = _long_enough(found, pattern, group, least)
        out[kind] = found
    return out


def _long_enough(found: Column, pattern: str, group: int, least: int) -> Column:
    return F.filter(found, lambda x: F.length(F.regexp_extract(x["hit"], pattern, group)) >= least)


def _clog(n: Column) -> Column:
    """n * log2(n) from a table over 0 to the window's length."""
    table = F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(WINDOW + 2)])
    return F.get(table, n)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once (a lambda's variable)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def entropy_spans(run: Column) -> Column:
    """array<struct<at, to>> of a run's characters in windows of high entropy; windows that touch join.

    One fold over the characters holds the window's sum of c * log2(c), how
    many of its characters are no hexadecimal digits, how many are digits, and
    the span still open.
    """
    empty = F.expr("CAST(array() AS array<struct<at:int,to:int>>)")
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("other"), F.lit(0).alias("digits"),
                     F.lit(-1).alias("open"), F.lit(-1).alias("until"), empty.alias("out"))

    def spans(chars):
        def flag(c: Column, pattern: str) -> Column:
            return F.coalesce(c.rlike(pattern).cast("int"), F.lit(0))

        def step(s, i):
            come, leaves = F.get(chars, i), i >= WINDOW
            gone = F.when(leaves, F.get(chars, i - WINDOW))
            window = F.slice(chars, F.greatest(i - WINDOW, F.lit(0)) + 1, F.least(i, F.lit(WINDOW)))
            counts = F.struct(
                F.size(F.filter(window, lambda x: x == gone)).alias("gone"),
                (F.size(F.filter(window, lambda x: x == come)) - (leaves & (gone == come)).cast("int")).alias("come"))

            def moved(n):
                less = F.when(leaves, _clog(n["gone"]) - _clog(n["gone"] - 1)).otherwise(0.0)
                return F.struct(
                    (s["sum"] - less + _clog(n["come"] + 1) - _clog(n["come"])).alias("sum"),
                    (s["other"] + flag(come, "[^0-9a-fA-F]") - flag(gone, "[^0-9a-fA-F]")).alias("other"),
                    (s["digits"] + flag(come, "[0-9]") - flag(gone, "[0-9]")).alias("digits"))

            def judged(w):
                high = (i >= WINDOW - 1) & (w["digits"] > 0) & (w["digits"] < WINDOW) & (
                    math.log2(WINDOW) - w["sum"] / WINDOW
                    >= F.when(w["other"] == 0, F.lit(HEX_BITS)).otherwise(F.lit(WORD_BITS)))
                return F.struct(w["sum"].alias("sum"), w["other"].alias("other"), w["digits"].alias("digits"),
                                high.alias("high"))

            def kept(w):
                first = i - (WINDOW - 1)
                fresh = w["high"] & ((s["open"] < 0) | (first > s["until"]))
                closed = F.concat(s["out"], F.array(F.struct(s["open"].alias("at"), s["until"].alias("to"))))
                return F.struct(
                    w["sum"].alias("sum"), w["other"].alias("other"), w["digits"].alias("digits"),
                    F.when(fresh, first).otherwise(s["open"]).alias("open"),
                    F.when(w["high"], i + 1).otherwise(s["until"]).alias("until"),
                    F.when(fresh & (s["open"] >= 0), closed).otherwise(s["out"]).alias("out"))

            return _let(_let(_let(counts, moved), judged), kept)

        def done(s):
            last = F.array(F.struct(s["open"].alias("at"), s["until"].alias("to")))
            return F.when(s["open"] >= 0, F.concat(s["out"], last)).otherwise(s["out"])

        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step, done)

    return _let(F.split(run, ""), spans)


def pieces(run: Column) -> Column:
    """array<struct<at, to, hit>>: the pieces of an allow-listed run that may hold a secret.

    They are what lies between placeholders, or, where a placeholder is part of
    a key, the other segments of a window's length.
    """

    def between(found):
        starts = F.concat(F.array(F.lit(0)), F.transform(found, lambda x: x["to"]))
        ends = F.concat(F.transform(found, lambda x: x["at"]), F.array(F.length(run)))
        gaps = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("at"), b.alias("to"), run.substr(a + 1, b - a).alias("hit")))

        def trimmed(x):
            hit = F.regexp_replace(x["hit"], "^[=_/+-]+", "")
            return F.struct((x["to"] - F.length(hit)).alias("at"), x["to"].alias("to"), hit.alias("hit"))

        return F.transform(gaps, trimmed)

    found = F.when(run.rlike(MIXED), match_spans(run, SEGMENT)).otherwise(_let(match_spans(run, PLACEHOLDER), between))
    return F.filter(found, lambda x: x["hit"].rlike("^" + CANDIDATE) & ~x["hit"].rlike(PLAIN)
                    & (x["hit"].rlike(NO_WORD) | ~x["hit"].rlike(TWO)))


def all_spans(text: Column, allow: str = ALLOW, inside: bool = False) -> Column:
    """array<struct<at, rank, kind, to, base>> in order of start, then kind; entropy spans inside a base span are left out."""

    def named(column: Column, kind: str, rank: int, base: bool) -> Column:
        return F.transform(column, lambda x: F.struct(x["at"].alias("at"), F.lit(rank).alias("rank"),
                                                      F.lit(kind).alias("kind"), x["to"].alias("to"),
                                                      F.lit(base).alias("base")))

    spans = base_spans(text)
    base = F.concat(*[named(spans[k], k, i, True) for i, (k, *_) in enumerate(KINDS)])
    if inside:

        def parts(r):
            moved = F.transform(pieces(r["hit"]), lambda x: F.struct(
                (x["at"] + r["at"]).alias("at"), (x["to"] + r["at"]).alias("to"), x["hit"].alias("hit")))
            return F.when(r["hit"].rlike(allow), moved).otherwise(F.array(r))

        runs = F.flatten(F.transform(match_spans(text, CANDIDATE), parts))
    else:
        runs = F.filter(match_spans(text, CANDIDATE), lambda x: ~x["hit"].rlike(allow))
    high = F.flatten(F.transform(runs, lambda r: F.transform(
        entropy_spans(r["hit"]), lambda x: F.struct((x["at"] + r["at"]).alias("at"), (x["to"] + r["at"]).alias("to")))))

    def both(b):
        new = F.filter(high, lambda x: ~F.exists(b, lambda y: (y["at"] <= x["at"]) & (y["to"] >= x["to"])))
        return F.array_sort(F.concat(b, named(new, "entropy", len(KINDS), False)))

    return _let(base, both)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: str = ALLOW) -> DataFrame:
    """``doc_id, text, found``: the spans of each text (a null text is empty)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), all_spans(text, allow).alias("found"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["at"], x["to"])), ",")


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy``."""
    rows = scan(docs, id_col, text_col)

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *[count(k) for k, *_ in KINDS],
                       F.sha2(joined(F.filter("found", lambda x: x["base"])), 256).alias("base_sha256"),
                       joined(F.col("found")).alias("spans"), count("entropy"))


def redacted_text(text: Column, mark: str = "[secret]", allow: str = ALLOW, inside: bool = False) -> Column:
    """The text with every span replaced by ``mark`` (spans that overlap are replaced once); null stays null.

    ``inside`` also finds secrets in runs that the allow-list matches.
    """
    text = text.cast("string")

    def replaced(found):
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(s, x):
            more = F.concat(s["out"], F.substring(text, s["at"] + 1, F.greatest(x["at"] - s["at"], F.lit(0))), F.lit(mark))
            return F.struct(F.greatest(s["at"], x["to"]).alias("at"),
                            F.when(x["at"] >= s["at"], more).otherwise(s["out"]).alias("out"))

        rest = F.aggregate(found, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
        return F.when(F.size(found) > 0, rest).otherwise(text)

    return _let(all_spans(text, allow, inside), replaced)
