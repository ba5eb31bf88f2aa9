"""Grading rules on hand-made runs."""

import pytest

from patchloom.operators import grade

START, END = grade.START_MARK, grade.END_MARK


def logs(spark, rows):
    return spark.createDataFrame(rows, "instance_id string, repo string, log string")


def test_log_window_and_fallback(spark):
    rows = [
        ("in", "pallets/flask", f"PASSED out\n{START}\nPASSED a\n{END}\nPASSED tail"),
        ("out", "pallets/flask", f"PASSED x\n{START}\nnothing\n{END}"),
        ("noend", "pallets/flask", f"{START}\nPASSED a"),
        ("bad", "pallets/flask", f">>>>> Tests Errored\n{START}\nPASSED a\n{END}"),
    ]
    runs, status = grade.grade_logs(logs(spark, rows), ["instance_id"], "pytest")
    assert {r["instance_id"]: r["found"] for r in runs.collect()} == {"in": True, "out": True, "noend": False, "bad": False}
    assert {(r["instance_id"], r["test"]) for r in status.collect()} == {("in", "a"), ("out", "x")}


def test_mixed_formats_with_fallback(spark):
    rows = [
        ("google__gson-1", "google/gson", f"-Dtest=A\nBUILD SUCCESS\n{START}\nx\n{END}"),
        ("pallets__flask-1", "pallets/flask", f"{START}\nFAILED a - b\n{END}"),
        ("preactjs__preact-1", "preactjs/preact", f"Starting browser\n  S\n    ✔ a\n{START}\n{END}"),
    ]
    from patchloom.operators.logs.dispatch import parser_of
    from pyspark.sql import functions as F

    df = logs(spark, rows).withColumn("parser", parser_of(F.col("repo"), F.col("instance_id")))
    runs, status = grade.grade_logs(df, ["instance_id"])
    assert all(r["gradable"] and r["error"] is None for r in runs.collect())
    assert {(r["test"], r["status"]) for r in status.collect()} == {("A", "PASSED"), ("a", "FAILED"), ("S > a", "PASSED")}


def test_unknown_formats_are_errors_and_not_failures(spark):
    from patchloom.operators.logs.dispatch import parser_of
    from pyspark.sql import functions as F

    rows = [("a__a-1", "some/one", f"{START}\nPASSED a\n{END}"), ("jekyll__jekyll-1", "jekyll/jekyll", f"{START}\nPASSED a\n{END}"), ("b__b-1", "some/one", "PASSED a")]
    df = logs(spark, rows).withColumn("parser", parser_of(F.col("repo"), F.col("instance_id")))
    runs, status = grade.grade_logs(df, ["instance_id"])
    assert {(r["instance_id"], r["found"], r["gradable"], r["error"]) for r in runs.collect()} == {
        ("a__a-1", True, False, "unknown_format"), ("jekyll__jekyll-1", True, False, "unknown_format"), ("b__b-1", False, False, None)}
    gold = spark.createDataFrame([("a__a-1", F2P, "a")], "instance_id string, category string, test string")
    assert status.count() == 0 and grade.grade_tests(runs.filter("gradable"), gold, status, ["instance_id"]).count() == 0


def rates(spark, repo, gold, status):
    runs = spark.createDataFrame([("i", repo)], "instance_id string, repo string")
    g = spark.createDataFrame([("i", c, t) for c, t in gold], "instance_id string, category string, test string")
    s = spark.createDataFrame([("i", t, v) for t, v in status], "instance_id string, test string, status string")
    row = grade.grade_rates(grade.grade_tests(runs, g, s, ["instance_id"]), ["instance_id"]).first()
    return row["f2p_rate"], row["p2p_rate"]


F2P, P2P = "FAIL_TO_PASS", "PASS_TO_PASS"


@pytest.mark.parametrize("repo,gold,status,expected", [
    ("a/b", [(F2P, "x"), (P2P, "y")], [("x", "PASSED"), ("y", "XFAIL")], (1.0, 1.0)),
    ("a/b", [(F2P, "x"), (P2P, "y")], [("x", "ERROR")], (0.0, 0.0)),  # absent is failed
    ("a/b", [(F2P, "x"), (F2P, "z"), (P2P, "y")], [("x", "PASSED"), ("z", "SKIPPED"), ("y", "PASSED")], (1.0, 1.0)),
    ("a/b", [(F2P, "x"), (P2P, "y")], [("x", "SKIPPED"), ("y", "SKIPPED")], (1.0, 1.0)),  # nothing left scores 1
    ("a/b", [(F2P, "x"), (F2P, "z")], [("x", "PASSED"), ("z", "FAILED")], (0.5, 1.0)),
    ("chartjs/Chart.js", [(F2P, "x"), (P2P, "y")], [("y", "FAILED")], (1.0, 0.0)),  # absent succeeds
])
def test_rates(spark, repo, gold, status, expected):
    assert rates(spark, repo, gold, status) == expected


def test_run_report_counts(spark):
    data = spark.createDataFrame([(i,) for i in "abcdef"], "instance_id string")
    preds = spark.createDataFrame(
        [("a", "p"), ("b", "p"), ("c", ""), ("d", None), ("e", "p"), ("zz", "p")], "instance_id string, model_patch string")
    reports = spark.createDataFrame([("a", True), ("b", None)], "instance_id string, resolved boolean")
    states = grade.run_states(data, preds, reports)
    assert grade.run_report(states, preds).first().asDict() == {
        "total_instances": 6, "submitted_instances": 6, "completed_instances": 2, "resolved_instances": 1,
        "unresolved_instances": 0, "empty_patch_instances": 2, "error_instances": 2, "schema_version": 2,
    }
    ids = {(r["list_name"], r["instance_id"]) for r in grade.run_report_ids(states, preds).collect()}
    assert ("incomplete_ids", "f") in ids and ("completed_ids", "b") in ids and ("error_ids", "b") in ids


def test_no_patch_still_reports(spark):
    """One instance, a prediction without a patch: a report with schema version 2."""
    data = spark.createDataFrame([("i",)], "instance_id string")
    preds = spark.createDataFrame([("i", None)], "instance_id string, model_patch string")
    row = grade.run_report(grade.run_states(data, preds, spark.createDataFrame([], "instance_id string, resolved boolean")), preds).first()
    assert (row["schema_version"], row["empty_patch_instances"]) == (2, 1)


def test_work_list_rejects_unknown_ids(spark):
    data = spark.createDataFrame([("a",)], "instance_id string")
    preds = spark.createDataFrame([("zz", "p")], "instance_id string, model_patch string")
    with pytest.raises(ValueError, match="zz"):
        grade.work_list(data, preds)


def test_latest_prediction(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "y")], "instance_id string, seq long, model_patch string")
    assert grade.latest_predictions(df).first()["model_patch"] is None


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_large_sides_do_not_pass_through_the_driver(spark, tmp_path):
    """Stored runs and parts of a fact table have small files but many rows."""
    from patchloom.plans.views import load

    keys = ["model", "instance_id"]
    runs = spark.range(3).selectExpr("'m' model", "'i' || id instance_id", "'r/r' repo", "true found")
    gold = spark.range(3).selectExpr("'i' || id instance_id", "'FAIL_TO_PASS' category", "'t' test")
    status = spark.range(2).selectExpr("'m' model", "'i' || id instance_id", "'t' test", "'PASSED' status")
    preds = spark.range(4).selectExpr("'m' model", "'i' || id instance_id", "'p' model_patch")
    graded = grade.grade_tests(runs, gold, status, keys)
    reports = grade.instance_reports(preds, runs, grade.grade_rates(graded, keys), keys)
    assert "BroadcastHashJoin" not in _plan(reports)
    assert {r["instance_id"]: r["resolved"] for r in reports.collect()} == {"i0": True, "i1": True, "i2": False, "i3": False}

    rows = {
        "orders": "id o_orderkey, id o_custkey, 'O' o_orderstatus, 1.0D o_totalprice, timestamp'1995-01-01' o_orderdate, 'm' o_orderpriority",
        "customer": "id c_custkey, 'c' c_name, cast(id AS int) c_nationkey, 1.0D c_acctbal, 's' c_mktsegment",
        "nation": "cast(id AS int) n_nationkey, 'n' n_name, 0 n_regionkey",
        "lineitem": "id l_orderkey, id l_partkey, id l_suppkey, cast(id AS int) l_linenumber, 1.0D l_quantity",
    }
    for name, sql in rows.items():
        spark.range(8).selectExpr(*sql.split(", ")).write.parquet(f"{tmp_path}/{name}.parquet")
    view = load(spark, str(tmp_path), "v_gold")
    assert "SortMergeJoin [l_orderkey" in _plan(view)
    assert view.count() == 8
