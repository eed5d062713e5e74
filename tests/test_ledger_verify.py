from pyspark.sql import functions as F

from veritable.operators import claims as M
from veritable.operators import domain as U
from veritable.operators import grounding as N
from veritable.operators import ledger as L
from veritable.operators import profile as P
from veritable.sources import readers as R


def test_verify_findings_and_report(spark):
    findings = spark.createDataFrame([("f1", "Sales rose.", "high", "act A", 0), ("f2", "Gap seen.", "high", "act B", 1),
                                      ("f3", "Mixed.", "medium", "act A", 2), ("f4", "Gone.", "medium", None, 3)],
                                     "finding_id string, result string, confidence string, action string, position int")
    grounding = spark.createDataFrame([("f1", "Sales rose.", False), ("f2", "Gap seen.", True), ("f4", " ", True)],
                                      "finding_id string, result_text string, changed boolean")
    sig = spark.createDataFrame([("f2", "weak"), ("f3", "noise")], "finding_id string, verdict string")
    conf = spark.createDataFrame([("f1", "mix by region")], "finding_id string, caveat string")
    out = {r["finding_id"]: r for r in N.verify_findings(findings.drop("action", "position"), grounding, sig, conf).collect()}
    assert set(out) == {"f1", "f2"}                 # f3 noise dropped, f4 emptied by grounding
    assert out["f1"]["confidence"] == "medium"      # caveat demotes once
    assert out["f2"]["confidence"] == "medium"      # grounding changed it (high -> medium), weak caps at medium
    per = spark.createDataFrame([("f1", 2)], "finding_id string, removed_sentences long")
    rep = N.verification_report(findings, N.verify_findings(findings.drop("action", "position"), grounding, sig, conf),
                                per, spark.createDataFrame([("f1", 3)], "finding_id string, checked long")).first()
    assert rep["checked"] == 4 and rep["dropped"] == 2 and rep["caveats"] == 1 and rep["removed"] == 2
    acts = [r["action"] for r in N.action_list(findings).collect()]
    assert acts == ["act A", "act B"]
    assert {r["confidence"] for r in N.downgrade_all(findings).collect()} == {"low"}


def test_run_quality_score(spark):
    stages = spark.createDataFrame([("r", "done")] * 9 + [("r", "failed")], "run_id string, status string")
    findings = spark.createDataFrame([("r", True, "e", "a", "c1"), ("r", False, "", "a", None)],
                                     "run_id string, grounded boolean, evidence string, action string, chart_id string")
    charts = spark.createDataFrame([("r", "c1")], "run_id string, chart_id string")
    errors = spark.createDataFrame([("r", "boom")], "run_id string, message string")
    s = U.run_quality(stages, findings, charts, errors).first()
    expected = 100 * (0.2 * 0.9 + 0.2 * 0.5 + 0.15 * 0.5 + 0.1 * 1.0 + 0.1 * 0.5 + 0.15 + 0.1 - 0.25 * 0.1)
    assert s["score"] == round(expected, 1)


def test_ledger_versions_upsert_review(spark):
    hist = spark.createDataFrame([
        ("m1", "p", "VIP spend over 5000", "rule", "active", "project", ["revenue"], 1, None, "t1"),
        ("m1", "p", "VIP spend over 6000", "rule", "active", "project", ["revenue"], 2, "2020-01-01", "t2"),
        ("m2", "p", "Ignore test orders", "rule", "active", "dataset", ["status"], 1, None, "t1"),
    ], L.MEMORY_SCHEMA)
    cur = {r["id"]: r for r in L.latest_versions(hist).collect()}
    assert cur["m1"]["version"] == 2 and cur["m1"]["statement"].endswith("6000")
    active = {r["id"] for r in L.active_memory(hist, "p", ["revenue"], "2019-01-01").collect()}
    assert active == {"m1"}                                     # m2 is dataset-scoped on a column not present
    assert {r["id"] for r in L.active_memory(hist, "p", ["Status"], "2024-01-01").collect()} == {"m2"}   # m1 is past its date
    expired = L.expire(hist, "2024-01-01").collect()
    assert [(r["id"], r["status"], r["version"]) for r in expired] == [("m1", "expired", 3)]
    changes = spark.createDataFrame([
        ("m3", "p", "vip spend over 6000", "rule", "active", "project", ["revenue"], 0, None, "t3"),   # duplicate
        ("m4", "p", "Peak is December", "rule", "active", "project", [], 0, None, "t3"),
        ("m5", "p", " peak is december ", "rule", "active", "project", [], 0, None, "t3"),             # repeats m4 in the batch
        ("m2", "p", "Ignore test orders", "rule", "archived", "dataset", ["status"], 0, None, "t3"),
    ], L.MEMORY_SCHEMA)
    after = L.latest_versions(L.upsert(hist, changes))
    got = {r["id"]: (r["status"], r["version"]) for r in after.collect()}
    assert "m3" not in got and "m5" not in got and got["m4"] == ("active", 1) and got["m2"] == ("archived", 2)
    lessons = spark.createDataFrame([("l1", "p", "x", "pending"), ("l2", "p", "y", "pending")],
                                    "lesson_id string, project_id string, statement string, status string")
    reviews = spark.createDataFrame([("l1", "approve")], "lesson_id string, decision string")
    st = {r["lesson_id"]: r["status"] for r in L.review_lessons(lessons, reviews).collect()}
    assert st == {"l1": "approved", "l2": "pending"}
    done = spark.createDataFrame([("l1", "p", "x", "rejected")], lessons.schema)
    assert L.review_lessons(done, reviews).first()["status"] == "rejected"      # reviewed before: stays
    grown = {r["id"]: r["statement"] for r in L.approve_into_memory(hist, lessons, reviews, "t4").collect()}
    assert grown["lesson:l1"] == "x" and "lesson:l2" not in grown
    back = {r["id"]: r for r in L.latest_versions(L.restore(hist, spark.createDataFrame([("m1", 1), ("zz", 1)], "id string, version int"), "t5")).collect()}
    assert back["m1"]["version"] == 3 and back["m1"]["statement"].endswith("5000") and "zz" not in back


def test_profile_counts_the_latest_rating_of_one_project(spark):
    rows = [("r1", "p", "finding", "k", "useful", None, '{"axis": "Sales"}', "1"),
            ("r1", "p", "finding", "k", "incorrect", "no", '{"axis": "Sales"}', "2"),
            ("r9", "q", "finding", "k", "useful", None, '{"axis": "Sales"}', "3")]
    profile = L.preference_profile(spark.createDataFrame(rows, L.FEEDBACK_SCHEMA), "p").collect()
    assert [(r["kind"], r["value"], r["score"], r["count"]) for r in profile] == [("axes", "sales", -2.0, 1)]


def test_policy_life_cycle(spark):
    rows = [("a", "p", 1, "active", {}, None), ("b", "p", 2, "validated", {}, "a"), ("c", "p", 3, "draft", {}, "b"),
            ("d", "q", 1, "active", {}, None)]
    df = spark.createDataFrame(rows, L.POLICY_SCHEMA)
    state = lambda x: {r["policy_id"]: r["status"] for r in x.collect()}
    assert state(L.activate(df, "c")) == state(df)                       # drafts cannot be activated
    on = L.activate(df, "b")
    assert state(on) == {"a": "retired", "b": "active", "c": "draft", "d": "active"}
    assert state(L.roll_back(on, "p")) == {"a": "active", "b": "retired", "c": "draft", "d": "active"}
    assert state(L.roll_back(df, "q")) == state(df)                      # no parent


def test_relevant_facts(spark):
    facts = spark.createDataFrame([("a", "revenue", "business"), ("b", "depth", "earth_science"), ("c", "x", "weather")],
                                  "fact_id string, column string, domain string")
    cols = spark.createDataFrame([("revenue",)], "column_name string")
    kept = {r["fact_id"] for r in M.relevant_facts(facts, cols, "earth_science").collect()}
    assert kept == {"a", "b"}


def test_operation_log_and_digest(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "x int, y string")
    log = R.OperationLog()
    step = log.track("drop blanks", df.filter(F.col("y").isNotNull()), columns_before=2)
    step.collect()                                  # the action the counts ride on
    row = log.table(spark, rows_at_start=3).first()
    assert row["rows_before"] == 3 and row["rows_after"] == 2
    text = R.digest(df, P.profile_dataset(df))
    assert "x (" in text and "First 5 rows" in text
