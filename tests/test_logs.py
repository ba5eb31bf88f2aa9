"""Log formats: fixed cases, rules of state, long logs, dispatch."""

import pytest

from patchloom.operators.logs.dispatch import parse_test_logs, parse_with, parser_of
from pyspark.sql import functions as F


def parse(spark, parser, *logs):
    df = spark.createDataFrame(list(enumerate(logs)), "log_id int, log string")
    out = [{} for _ in logs]
    for r in parse_with(df, ["log_id"], parser).collect():
        out[r["log_id"]][r["test"]] = r["status"]
    return out if len(logs) > 1 else out[0]


CASES = [
    ("gradle", "a.B > one PASSED\na.B > two FAILED", {"a.B > one": "PASSED", "a.B > two": "FAILED"}),
    ("gradle", "> Task :t\nWARNING\na.B > one PASSED\n$ sh", {"a.B > one": "PASSED"}),
    ("gradle", "a.B > one\nWARNING: x\nPASSED\na.B > two FAILED", {"a.B > one": "PASSED", "a.B > two": "FAILED"}),
    ("gradle", "a.B > one\nPASSED\nFAILED", {"a.B > one": "PASSED"}),
    ("maven", "+ mvn -Dtest=A\nBUILD SUCCESS\n+ mvn -Dtest=B\nBUILD FAILURE", {"A": "PASSED", "B": "FAILED"}),
    ("maven", "-Dtest=A\n-Dtest=B\n[INFO] BUILD SUCCESS\n[INFO] BUILD FAILURE", {"A": "PASSED", "B": "FAILED"}),
    ("maven", "BUILD SUCCESS\n-Dtest=A", {"A": "PASSED"}),
    ("pytest", "PASSED a\nFAILED a - x\nERROR", {"a": "FAILED"}),
    ("pytest", "PASSED: a", {"a": "PASSED:"}),
    ("pytest_options", "PASSED t[/x/y/z]\nFAILED t[//x]\nPASSED t[/a*/b]", {"t[/z]": "PASSED", "t[//x]": "FAILED", "t[/a*/b]": "PASSED"}),
    ("pytest_v2", "\x1b[32mPASSED\x1b[0m a\nb FAILED", {"a": "PASSED", "b": "FAILED"}),
    ("matplotlib", "PASSED t[MouseButton.LEFT]", {"t[1]": "PASSED"}),
    ("sympy", "test_a ok\n___ x/test_q.py:test_a ___\ntest_b E", {"x/test_q.py:test_a": "FAILED", "test_a": "PASSED", "test_b": "ERROR"}),
    ("phpunit", " ✔ first\nMy Suite (A)\n ✘ second", {"None > first": "PASSED", "My Suite > second": "FAILED"}),
    ("django", "t (m) ... noise\nmore\nok", {"t (m)": "PASSED"}),
    ("django", "t (m) ... ok\nERROR: t (m)", {"t (m)": "PASSED", "t": "ERROR"}),
    ("django", "a ... Internal Server Error: /x/\nok", {"a": "PASSED"}),
    ("django", "Applying sites.0002_alter_domain_unique...test_no_migrations (x) ... ok", {"test_no_migrations (x)": "PASSED"}),
    ("redis", "[err]: a b in tests/x.tcl\n[ok]: c (3 ms)\n[ignore]: d", {"a b": "FAILED", "c": "PASSED", "d": "SKIPPED"}),
    ("minitest", "T#a. = 0.1 s = .\nT#b. = 0.1 s = F", {"T#a": "PASSED", "T#b": "FAILED"}),
    ("rspec", "A - pending\nA - passed", {"A": "PASSED"}),
    ("react_pdf", "PASS a.js (3.1 s)\nFAIL b.js\nFAIL c.js (4ms)", {"a.js": "PASSED", "b.js": "FAILED", "c.js": "FAILED"}),
    ("chart_js", "\x1b[31mChrome 1.2 (Mac OS) bar é FAILED\x1b[0m", {"bar é ": "FAILED"}),
    ("karma", "x\nStarting browser\n  S\n    T\n    ✔ a\n  U\n    ✖ b\nSUMMARY:\n    ✔ c", {"S > T > a": "PASSED", "S > b": "FAILED"}),
    ("calypso", "+ ./node_modules/.bin/jest x\n  S\n    T\n      ✓ a (3ms)\n    U\n      ✕ b\nTest Suites: 1\n  ✓ no", {"S - T - a": "PASSED", "S - U - b": "FAILED"}),
    ("p5js", "log\n{\n  \"a\": 1\n}\n  1) outer\n       inner:\n  2) flat\nsame:\n<x>q</x>", {"outer:inner": "FAILED"}),
    ("doctest", "noise <doctest><TestCase name='c'><SubCase name='s'><Expression success='true'/><SubCase name='n'><Expression success='false'/></SubCase></SubCase></TestCase></doctest> end",
     {"c > s": "FAILED", "c > n": "FAILED"}),
    ("doctest", "<doctest><broken", {"(broken report)": "ERROR"}),
    ("doctest", "<doctest><TestCase name='a'></SubCase></TestCase></doctest>", {"(broken report)": "ERROR"}),
    ("doctest", "no report", {}),
    ("p5js", "  1) " + "x" * 3000 + ":", {"x" * 3000: "FAILED"}),
]


@pytest.mark.parametrize("parser,log,expected", CASES)
def test_case(spark, parser, log, expected):
    assert parse(spark, parser, log) == expected


# One state rule per case: what pairs with what, what resets, what is left over.
STATE_CASES = [
    ("maven", "-Dtest=A\nnoise\n-Dtest=B\nBUILD SUCCESS", {"A": "PASSED"}),
    ("maven", "BUILD FAILURE\nBUILD SUCCESS\n-Dtest=A\n-Dtest=B\n-Dtest=C\nBUILD SUCCESS", {"A": "PASSED", "B": "FAILED", "C": "PASSED"}),
    ("maven", "x -Dtest=A BUILD FAILURE\n-Dtest=A\nBUILD SUCCESS", {"A": "PASSED"}),
    ("maven", "-Dtest=A\nBUILD SUCCESS\nBUILD FAILURE", {"A": "PASSED"}),
    ("maven", "BUILD SUCCESS", {}),
    ("gradle", "a.B > c\na.B > d\nPASSED", {"a.B > d": "PASSED"}),
    ("gradle", "a.B > c\na.B > d FAILED\nPASSED", {"a.B > d": "FAILED"}),
    ("gradle", "a.B > c\n> x PASSED\nFAILED\nPASSED", {"a.B > c": "FAILED"}),
    ("gradle", "  a.B > c PASSED  \na.B > c FAILED", {"a.B > c": "FAILED"}),
    ("phpunit", "Aa (x)\n ✔ one\nÉ b (y)\n  ↩ one\nnoise\n✘ one", {"Aa > one": "PASSED", "É b > one": "FAILED"}),
    ("phpunit", "Aa (x)\n ✘ one\nBb (x)\nAa (y)\n ✔ one", {"Aa > one": "PASSED"}),
    ("django", "ok\nt (m) ... x\nok\nok 2\nu (m) ... skipped 'no'", {"t (m)": "PASSED", "u (m)": "SKIPPED"}),
    ("django", "a ... FAIL\nb ... ERROR\nFAIL: c (x)\n--version is equivalent to version", {"a": "FAILED", "b": "ERROR", "c": "FAILED", "--version is equivalent to version": "PASSED"}),
    ("karma", "Starting browser\n  A\n    B\n      ✔ x\n    C\n      ✔ y\n  D\n    ✖ z", {"A > B > x": "PASSED", "A > B > y": "PASSED", "A > z": "FAILED"}),
    ("karma", "SUMMARY:\nStarting browser\n ✔ x", {}),
    ("karma", " ✔ x", {}),
    ("karma", "Starting browser\n\n✔ top\nSUMMARY:", {"top": "PASSED"}),
    ("karma", "Starting browser\n ✔ top\nStarting browser\n ✖ low", {"top": "PASSED", "low": "FAILED"}),
    ("calypso", "  S\n    ✓ no", {}),
    ("calypso", "a ./node_modules/.bin/jest b\n  S\n    ✓ x (3ms)\n  T\n    ✕ y (3ms) z\n    ✓ é\n  ● stop\n  U\nc ./node_modules/.bin/jest d\n    ✕ k", {"S - x": "PASSED", "T - é": "PASSED", "T - k": "FAILED"}),
    ("calypso", " ./node_modules/.bin/jest \n ✓ alone", {"- alone": "PASSED"}),
    ("p5js", "  1) a\n    b\n  c:", {}),
    ("p5js", " 1) a:\nx [\n 2) in a list:\n]\n{ 3) one line: }\n 4) d:\n}\n 5) e:", {"a": "FAILED", "d": "FAILED", "e": "FAILED"}),
    ("p5js", "<a><a>1) x:</a> 2) y:</a>\n 3) z:\n<b> 4) open:\n 1 < 2", {"z": "FAILED"}),
    ("doctest", '<doctest><TestCase name="a &lt;b&gt;"><SubCase name="s"/><SubCase><Expression success="false"></Expression></SubCase></TestCase></doctest>', {"a <b> > s": "PASSED", "a <b> > None": "FAILED"}),
]


@pytest.mark.parametrize("parser", sorted({c[0] for c in STATE_CASES}))
def test_state_rules(spark, parser):
    cases = [c for c in STATE_CASES if c[0] == parser] + [(parser, "", {})]
    assert parse(spark, parser, *(c[1] for c in cases)) == [c[2] for c in cases]


LONG_LOGS = {
    "maven": (["[INFO] noise " * 4] * 40 + ["-Dtest=T{i}", "BUILD FAILURE"], "T{i}", "FAILED"),
    "gradle": (["noise " * 9] * 9 + ["a.B > t{i}", "PASSED"], "a.B > t{i}", "PASSED"),
    "phpunit": (["noise " * 9] * 9 + ["Suite {i} (x)", " ✔ one"], "Suite {i} > one", "PASSED"),
    "django": (["noise " * 9] * 9 + ["t{i} (m) ... said", "ok"], "t{i} (m)", "PASSED"),
    "karma": (["noise " * 9] * 9 + [" ✖ t{i}"], "t{i}", "FAILED"),
    "calypso": (["noise " * 9] * 9 + ["    ✓ t{i} (3ms)"], "S - t{i}", "PASSED"),
    "p5js": (["noise " * 9] * 9 + ["<a>x</a>", "  {i}) t{i}:"], "t{i}", "FAILED"),
    "pytest": (["noise " * 9] * 9 + ["PASSED t{i}"], "t{i}", "PASSED"),
}


@pytest.mark.parametrize("parser", sorted(LONG_LOGS))
def test_megabytes_of_log(spark, parser):
    kinds, name, status = LONG_LOGS[parser]
    n = 1500
    head = {"karma": "Starting browser\n", "calypso": "x ./node_modules/.bin/jest y\n  S\n"}.get(parser, "")
    log = head + "\n".join(k.format(i=i) if "{i}" in k else k for i in range(n) for k in kinds)
    assert len(log) > 700_000
    assert parse(spark, parser, log) == {name.format(i=i): status for i in range(n)}


def test_mixed_formats_are_one_scan_without_python(spark, tmp_path):
    path = str(tmp_path / "logs")
    spark.createDataFrame([(1, "pallets/flask", "a-1", "x", "pytest")], "id int, repo string, instance_id string, log string, parser string").write.parquet(path)
    plan = parse_test_logs(spark.read.parquet(path).withColumn("body", F.col("log")), ["id"], body="body")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("FileScan") == 1 and "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_dispatch(spark):
    rows = [
        (1, "pallets/flask", "pallets__flask-1", "PASSED a\n--- PASS: b (0s)"),
        (2, "gin-gonic/gin", "gin-gonic__gin-2", "PASSED a\n--- PASS: b (0s)"),
        (3, "jekyll/jekyll", "jekyll__jekyll-8761", "x ...F"),
        (4, "jekyll/jekyll", "jekyll__jekyll-1", "x ...F"),
        (5, "google/gson", "google__gson-5", "-Dtest=A\nBUILD SUCCESS"),
        (6, "preactjs/preact", "preactjs__preact-6", "Starting browser\n  S\n    ✔ a"),
    ]
    logs = spark.createDataFrame(rows, "id int, repo string, instance_id string, log string").withColumn(
        "parser", parser_of(F.col("repo"), F.col("instance_id")))
    got = {(r["id"], r["test"], r["status"]) for r in parse_test_logs(logs, ["id"]).collect()}
    assert got == {(1, "a", "PASSED"), (2, "b", "PASSED"), (3, "x", "FAILED"), (5, "A", "PASSED"), (6, "S > a", "PASSED")}
    assert logs.filter("id = 4").first()["parser"] is None
