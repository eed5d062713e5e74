import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritable.functions.quantiles import exact_quantiles_many, global_quantiles
from veritable.functions.ranking import sum_of_top
from veritable.operators import claims as M
from veritable.operators import grounding as N


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(11)
    vals = np.concatenate([rng.normal(0, 1, 3000), np.full(500, 0.25), rng.integers(0, 5, 700)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles_many(df, {"x": probs}, max_rows=50)["x"]       # forces bracket narrowing
    want = np.quantile(vals, probs)
    assert got == pytest.approx(list(want), rel=1e-12, abs=1e-12)
    both = global_quantiles(df, {"x": probs})["x"]
    assert both == pytest.approx(list(want), rel=1e-12, abs=1e-12)


def test_crowded_brackets_are_narrowed(spark):
    from veritable.functions import quantiles as Q

    rng = np.random.default_rng(5)
    a = np.concatenate([rng.exponential(3.0, 4000), np.full(900, 1.5)])      # heavy tie inside the data
    b = rng.integers(0, 7, len(a)).astype(float)                              # few distinct values
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    probs = [0.05, 0.25, 0.5, 0.75, 0.99]
    # coarse sketch and tiny read limit: brackets are crowded and get narrowed
    got = Q.exact_quantiles_many(df, {"a": probs, "b": probs}, accuracy=100, max_rows=25)
    assert got["a"] == pytest.approx(list(np.quantile(a, probs)), rel=1e-12, abs=1e-12)
    assert got["b"] == pytest.approx(list(np.quantile(b, probs)), rel=1e-12, abs=1e-12)
    routed = Q.global_quantiles(df, {"a": probs, "b": probs})
    assert routed["a"] == pytest.approx(list(np.quantile(a, probs)), rel=1e-12, abs=1e-12)
    assert routed["b"] == pytest.approx(list(np.quantile(b, probs)), rel=1e-12, abs=1e-12)


def test_scatter_sample_equals_hash_order(spark):
    import hashlib

    from veritable.operators import charts as CH

    rows = [(i, j, float(i % 7) if (i + j) % 9 else None, float(i * j)) for i in range(60) for j in range(1, 6)]
    df = spark.createDataFrame(rows, "k bigint, n int, x double, y double")
    got = [tuple(r) for r in CH.scatter_sample(df, "x", "y", ["k", "n"], points=25).collect()]
    complete = [r for r in rows if r[2] is not None and r[3] is not None]
    want = sorted(complete, key=lambda r: (hashlib.md5(f"{r[0]}|{r[1]}|42".encode()).hexdigest(), r[0], r[1]))[:25]
    assert sorted(got) == sorted(want)


def test_grouped_quantile_matches_percentile(spark):
    from veritable.functions.quantiles import grouped_quantile

    rng = np.random.default_rng(3)
    rows = []
    for g, n in (("hot", 3000), ("mid", 400), ("one", 1), ("two", 2), ("tie", 300)):
        for i in range(n):
            v = 7.0 if g == "tie" and i % 3 else float(np.round(rng.lognormal(2, 1), 2))
            rows.append((g, v if i % 17 else None))
    rows.append((None, 5.0))
    rows += [("empty", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for p in (0.5, 0.25, 0.9):
        want = {r["g"]: r["q"] for r in df.filter(F.col("g").isNotNull())
                .groupBy("g").agg(F.percentile("v", p).alias("q")).collect()}
        assert want["empty"] is None
        for acc in (10000, 20):                     # a coarse sketch forces the fallback path
            got = {r["g"]: r["_q"] for r in grouped_quantile(df, ["g"], "v", p, accuracy=acc).collect()}
            assert set(got) == set(want)
            for g in want:
                if want[g] is None:
                    assert got[g] is None
                else:
                    assert got[g] == pytest.approx(want[g], rel=1e-12, abs=1e-12), (p, acc, g)


def test_sum_of_top_is_exact(spark):
    rng = np.random.default_rng(2)
    vals = rng.exponential(10, 5000).round(2)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    for k in (1, 10, 500, 4999):
        assert sum_of_top(df, "x", k) == pytest.approx(float(np.sort(vals)[::-1][:k].sum()), rel=1e-12)


_MULT = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9}


def _py_figures(text):
    """Figures read one character after the other: the check on the patterns."""
    out, i = [], 0
    letter = lambda c: c.isalpha() or c == "_"
    part = lambda c: letter(c) or c.isnumeric()
    digit = lambda c: c in "0123456789"

    def run(i, test):
        while i < len(text) and test(text[i]):
            i += 1
        return i

    while i < len(text):
        c, after = text[i], text[i + 1:i + 2]
        if letter(c):
            i = run(i, part)
            i += text[i:i + 1] == "-"
        elif c == "." and after and part(after):
            i = run(i + 1, lambda c: part(c) or c in ".,")
        elif digit(c) or c in "+-" and after and digit(after):
            sign = -1 if c == "-" else 1
            start = i + (c in "+-")
            i = run(start, lambda c: digit(c) or c in ".,")
            numeral = text[start:i]
            bare = numeral.rstrip(".,")
            j = run(i, str.isspace)
            word = ""
            if j < len(text) and letter(text[j]):
                end = run(j, part)
                word, glued, i = text[j:end].lower(), j == i and bare == numeral, end
            j = run(i, str.isspace)
            percent = text[j:j + 1] == "%"
            i = j + 1 if percent else i
            i += text[i:i + 1] == "-"
            percent = percent and (not word or word in _MULT)
            groups = bare.split(".")[0].split(",")
            thousands = len(groups) > 1 and 1 <= len(groups[0]) <= 3 and all(len(g) == 3 for g in groups[1:]) and bare.count(".") <= 1 and "," not in bare.partition(".")[2]
            pieces = [bare.replace(",", "")] if thousands else bare.split(",")
            for k, piece in enumerate(pieces):
                last = k == len(pieces) - 1
                if not piece or piece.count(".") > 1 or piece[0] == "." or piece[-1] == "." or last and word and word not in _MULT and glued:
                    continue
                v = float(piece) * (_MULT.get(word, 1.0) if last else 1.0) * (sign if k == 0 else 1)
                out.append((v, last and percent))
        else:
            i += 1
    return out


TEXTS = ["Revenue grew 45% to 2.8M in March.", "We shipped 1,234,567 orders; 3.5K were late.",
         "Margin fell -3.7% while costs hit 2 billion.", "Item A12 and v2.0 are not figures.",
         "Noise: 12abc, 7 days, 1990 and 2024 count.", "Ratio 0.5 and +15 points, 100mn budget.",
         "2019-2020, x-5, a.5 and -7", "1,234.56 but 12,34% and 1,23,456", "v1.2.3 on 31.12.2024; 3.5.1", "10 % of 5 m % or 6 apples %",
         "$5,000.25K (12.) 7,abc 8,9x 1.5e5 é4 4é _1 1_", "5", "", "%", "-", "no digits", "12,", "1,000,00", "+1,000bn.", "\u0663 3\u0663 x\n9\t%"]


def test_random_texts_read_as_one_by_one(spark):
    rng = random.Random(6)
    alphabet = ["1", "22", "333", "0", ",", ".", " ", "%", "-", "+", "k", "Million", "mn", "x", "_", "(", "é", "\n", "$"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))) for _ in range(3_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in N.extract_figures(df, "text", ["id"]).orderBy("id", "ordinal").collect():
        got.setdefault(r["id"], []).append((r["value"], r["is_percentage"]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == _py_figures(t), t


def test_many_facts_equal_brute_force(spark):
    """A million facts, most of them small: as many bucket rows as magnitudes, no broadcast hint, the same hits."""
    facts = spark.range(1_000_000).select((F.col("id") % 700_001 / 37_000.0 + F.when(F.col("id") % 3 == 0, 50.0).otherwise(0.0)).alias("value"),
                                          (F.col("id") % 5 == 0).alias("is_percentage"))
    rng = np.random.default_rng(3)
    figs = [(0, i, float(np.round(v, 2)), bool(rng.random() < 0.5)) for i, v in enumerate(np.concatenate([rng.uniform(-3, 25, 150), rng.uniform(20, 90, 150), [0.0, 1e9, 71.3]]))]
    df = spark.createDataFrame(figs, "doc int, ordinal int, value double, is_percentage boolean")
    out = N.match_figures(df, facts, ["doc"])
    assert "ResolvedHint" not in out._jdf.queryExecution().analyzed().toString()
    assert N.fact_buckets(facts).count() < 2_000
    pools = {p: np.sort([r[0] for r in facts.where(F.col("is_percentage") == p).select("value").collect()]) for p in (False, True)}

    def near(v, pool):
        tol, at = 0.5 if abs(v) <= 20 else abs(v) * 0.02, np.searchsorted(pools[pool], v)
        return any(abs(v - pools[pool][k]) <= tol for k in (at - 1, at) if 0 <= k < len(pools[pool]))

    for r in out.collect():
        v, p = r["value"], r["is_percentage"]
        want = not p and v == math.floor(v) and (0 <= v <= 12 or 1990 <= v <= 2100) or near(v, p) or (near(v / 100, False) if p else near(v, True))
        assert r["held"] == want, (v, p)


def test_figure_extraction_matches_plain_reading(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    got = {}
    for r in N.extract_figures(df, "text", ["id"]).collect():
        got.setdefault(r["id"], []).append((r["value"], r["is_percentage"]))
    for i, t in enumerate(TEXTS):
        assert sorted(got.get(i, [])) == sorted(_py_figures(t)), t


def _py_holds(value, pct, values, pcts):
    def match(v, pool):
        tol = 0.5 if abs(v) <= 20 else abs(v) * 0.02
        return any(abs(v - f) <= tol for f in pool)
    if not pct and value == math.floor(value) and (0 <= value <= 12 or 1990 <= value <= 2100):
        return True
    if match(value, pcts if pct else values):
        return True
    if pct and match(value / 100, values):
        return True
    return (not pct) and match(value, pcts)


def test_bucketed_match_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    facts_v = list(rng.choice([3.0, 17.2, 250.0, 1999.0, 48210.5, 2.8e6, -40.0, 0.35], 8))
    facts_p = [12.5, 45.0, 0.8]
    figs = [(i, float(v), bool(p)) for i, (v, p) in enumerate(zip(
        rng.choice([3.2, 17.9, 245.5, 260.0, 48000.0, 2.75e6, 2.9e6, -39.5, 35.0, 0.35, 45.4, 12.0, 13.3, 80.0], 60),
        rng.random(60) < 0.4))]
    fdf = spark.createDataFrame([(0, i, v, p) for i, v, p in figs], "doc int, ordinal int, value double, is_percentage boolean")
    facts = spark.createDataFrame([(float(v), False) for v in facts_v] + [(float(v), True) for v in facts_p],
                                  "value double, is_percentage boolean")
    got = {r["ordinal"]: r["held"] for r in N.match_figures(fdf, facts, ["doc"]).collect()}
    for i, v, p in figs:
        assert got[i] == _py_holds(v, p, facts_v, facts_p), (v, p)


def test_strip_removes_only_unsupported_sentences(spark):
    df = spark.createDataFrame([(1, "Sales were 500 units. Profit rose 37% last year. Nothing else changed.")],
                               "id int, text string")
    facts = spark.createDataFrame([(500.0, False)], "value double, is_percentage boolean")
    r = N.strip_unverified(df, "text", ["id"], facts).first()
    assert r["text"] == "Sales were 500 units. Nothing else changed." and r["removed_sentences"] == 1


def test_claim_extraction(spark):
    st = spark.createDataFrame([
        ("1", "Our peak season is November every year."),
        ("2", "VIP customers are those whose revenue is more than 5,000 per order."),
        ("3", "Please ignore cancelled orders."),
        ("4", "Nothing testable here."),
    ], "statement_id string, text string")
    catalog = spark.createDataFrame([("revenue", True), ("status", False)], "column_name string, is_numeric boolean")
    values = spark.createDataFrame([("status", "Cancelled"), ("status", "Completed")], "column_name string, value string")
    got = {r["statement_id"]: r for r in M.extract_claims(st, "text", catalog, values).collect()}
    assert got["1"]["kind"] == "peak_period" and got["1"]["period"] == "November"
    assert got["2"]["kind"] == "threshold" and got["2"]["column"] == "revenue" and got["2"]["operator"] == ">"
    assert float(got["2"]["value"]) == 5000.0
    assert got["3"]["kind"] == "exclusion" and got["3"]["value"] == "Cancelled"
    assert "4" not in got


def test_claim_forms(spark):
    """One sentence a form; None where nothing may be read."""
    cases = {
        "Large orders are anything above 10000 revenue": ("threshold", "revenue", ">", "10000", "Large Orders", None),
        "A big basket is one with at least £1,250.50 of order values. Busy is good.": ("threshold", "order_value", ">=", "1250.50", "A Big Basket", None),
        "Small lots are, as a rule, no more than 7 units!": ("threshold", "units", "<=", "7", "Small Lots", None),
        "Orders are above average revenue": None,                       # no number
        "Orders are large. Revenue above 500 counts": None,             # another sentence
        "Large things are above 500": None,                             # no column
        "is above 5 revenue": None,                                     # no label
        "Peak season starts in November": ("peak_period", None, None, None, None, "November"),
        "Our BEST quarter, by far, was Q3; the worst May.": ("peak_period", None, None, None, None, "Q3"),
        "The best of all the many things that we ever did was May": None,  # too far
        "Best wishes. See you in May": None,
        "Ignore cancelled invoices": ("exclusion", "order_status", None, "Cancelled", None, None),
        "please don't count any Returned items": ("exclusion", "order_status", None, "Returned", None, None),
        "Leave out the not_specified ones, exclude returned": ("exclusion", "priority", None, "4-NOT SPECIFIED", None, None),
        "skip 4-not specified orders": ("exclusion", "priority", None, "4-NOT SPECIFIED", None, None),
        "ignore return": ("exclusion", "order_status", None, "Returned", None, None),
        "Exclude nonsense rows": None,
        "We prefer blue packaging": None,
        "ignore": None, "": None, "...": None,
        "Peak is in May. Ignore cancelled": ("peak_period", None, None, None, None, "May"),
        "Ignore cancelled. Large orders are over 9 units": ("threshold", "units", ">", "9", "Large Orders", None),
    }
    cases["Leave out the not_specified ones, exclude returned"] = None   # values are looked up from their beginning
    st = spark.createDataFrame([*enumerate(cases), (99, None)], "statement_id long, text string").repartition(3)
    catalog = spark.createDataFrame([("revenue", True), ("order_value", True), ("value", True), ("units", True), ("order_status", False)],
                                    "column_name string, is_numeric boolean")
    values = spark.createDataFrame([("order_status", "Cancelled"), ("order_status", "Completed"), ("order_status", "Returned"), ("priority", "4-NOT SPECIFIED")],
                                   "column_name string, value string")
    got = {r["statement_id"]: tuple(r)[1:] for r in M.extract_claims(st, "text", catalog, values).collect()}
    assert got == {i: want for i, want in enumerate(cases.values()) if want}
    none = values.where("false")
    assert M.extract_claims(st, "text", catalog.where("false"), none).where("kind <> 'peak_period'").collect() == []


def test_claims_read_statements_once(spark, tmpdir_path):
    """All kinds of claims come from one reading of the statements, dealt to many tasks; rows that share an id are one statement."""
    rows = [("1", "Big baskets are those over 70."), ("1", "It is the revenue that counts."), ("2", "Skip all returned."), ("2", "The best month is may"),
            (None, "Big baskets are over 5 revenue"), ("3", "Exclude the"), ("4", "It is is over 3 revenue over 4")]
    spark.createDataFrame(rows, "statement_id string, text string").coalesce(1).write.mode("overwrite").parquet(f"{tmpdir_path}/s")
    st = spark.read.parquet(f"{tmpdir_path}/s")
    catalog = spark.createDataFrame([("revenue", True), ("s", True)], "column_name string, is_numeric boolean")
    values = spark.createDataFrame([("status", "Returned")], "column_name string, value string")
    found = M.extract_claims(st, "text", catalog, values)
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == {
        "1": ("threshold", "revenue", ">", "70", "Big Baskets", None), "2": ("peak_period", None, None, None, None, "May"),
        "4": ("threshold", "revenue", ">", "3", "It", None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [statement_id") == 1 and "Repartition" in plan


def test_claim_tests(spark):
    df = spark.createDataFrame([(float(v), "Cancelled" if v % 10 == 0 else "Done") for v in range(1, 101)],
                               "revenue double, status string")
    claims = [M.Claim("threshold", "revenue", ">", 90, claim_id="t"), M.Claim("threshold", "revenue", ">", 0, claim_id="all"),
              M.Claim("exclusion", "status", values=["cancelled"], claim_id="x")]
    res = {r["claim_id"]: r for r in M.test_claims(df, claims).collect()}
    assert res["t"]["holds"] and not res["all"]["holds"] and not res["x"]["holds"] and res["x"]["matching"] == 10
