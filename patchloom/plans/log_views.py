"""Test-log views: one short log per event, rendered in the format of each framework.

``TEMPLATES[parser]`` lists the line kinds of a format. The kind of a line depends on
the event type, the event and the line number; the test number on the user. Names
repeat inside a log with other outcomes, so the last-wins rule is exercised.
"""

from __future__ import annotations

from patchloom.plans.views import NL, q, view

TEMPLATES: dict[str, list[str]] = {
    "pytest": ["PASSED t{n}", "FAILED t{n} - msg é", "SKIPPED [{n}] t.py:3: why", "XFAIL t{n} reason", "noise {n}",
               "ERROR", "PASSED: t{n}", " PASSED indented"],
    "pytest_options": ["PASSED t[/a/b/{n}]", "FAILED t[/a/b/{n}] - msg", "PASSED t[//x/{n}] z", "ERROR t[/a/*/{n}]tail",
                       "SKIPPED t{n}", "noise", "PASSED t[x-{n}]", "FAILED t[/q/{n}]"],
    "pytest_v2": ["\x1b[32mPASSED\x1b[0m t{n}", "t{n} FAILED", "FAILED t{n} - boom", "u{n}\tPASSED  x SKIPPED",
                  "noise", "t{n} [12m XFAIL", "ERROR t{n}", "PASSED"],
    "matplotlib": ["PASSED t[MouseButton.LEFT-{n}]", "FAILED t[MouseButton.RIGHT-{n}] - x", "PASSED t[1-{n}]",
                   "FAILED t[3-{n}]", "noise MouseButton.LEFT", "ERROR t{n}"],
    "seaborn": ["FAILED t{n} - x", "t{n} PASSED [ 5%]", "PASSED t{n}", "x t{n} PASSED y", "noise", "PASSED PASSED t{n}"],
    "sympy": ["test_a{n} ok", "test_a{n} F", "  test_b{n} [x] E  ", "____ sympy/x/tests/test_q.py:test_a{n} ____",
              "noise", "test_b{n} f", "_ a.py:test_b{n} _", "test_c{n} ok"],
    "gotest": ["--- PASS: T{n} (0.1s)", "--- FAIL: T{n} (0.2s)", "    --- SKIP: T{n}/sub (x) (0.0s)", "=== RUN T{n}",
               "--- PASS: T{n}", "ok pkg"],
    "cargo": ["test m::t{n} ... ok", "test m::t{n} ... FAILED", "test m::t{n} ... ignored", "test t {n} ... ok",
              "  test\tm::u{n}  ...   ok  ", "noise"],
    "ant": ["[junit] [PASS] t{n}", "  [junit]  [FAIL]  t{n}", "[junit] [ERR] u{n} x", "[junit] [SKIP] t{n}", "noise",
            "[junit] [PASS] u{n} x"],
    "jest": ["  ✓ does {n} (12 ms)", " ✕ does {n} (3 s)", "○ skips {n}", "✓ does {n}", "noise ✓ x", "✕ é {n} (4ms)"],
    "jest_json": ["[PASSED] a {n}", "[FAILED] a {n}", "  [PASSED] b {n}  ", "[SKIPPED] a {n}", "noise", "[FAILED] b {n}"],
    "vitest": ["✓ a > b{n} 12ms", "× a > b{n} 3 s", "↓ c{n} [skipped]", "✓ c{n}", "✓ d{n} 5", "noise", "× d{n} 7m"],
    "tap": ["ok {n} does {n}", "not ok {n} does {n}", "ok x does", "  ok 7 does {n} # skip", "1..4", "not ok 1 b{n}"],
    "react_pdf": ["PASS pkg/t{n}.js (12.5ms)", "FAIL pkg/t{n}.js (1.2 s)", "PASS pkg/u{n}.js (3s)", "FAIL pkg/u{n}.js",
                  " PASS x{n}", "PASSED y", "PASS pkg/t{n}.js", "FAIL pkg/u{n}.js (4ms) tail"],
    "marked": ["{n}) fails  case ", "x) no", " 3) indented {n}", "{n}) é{n}", "noise", "4)none"],
    "chart_js": ["Chrome 12.0.{n} (Linux 0.0.0) chart {n} FAILED", "\x1b[31mChrome 1.2 (Mac) foo{n} FAILED\x1b[0m",
                 "noise FAILED", "Chrome 1.2 (Mac): Executed {n}", "Chrome 1 (A) bar{n}  FAILED", "Firefox 1 (A) x FAILED"],
    "redis": ["[ok]: t {n} (12 ms)", "[err]: t {n} in tests/unit/x.tcl", "[skip]: s {n}", "[ignore]: s {n} (3ms)", "noise",
              "[ok]: s {n}", "[exception]: t {n}"],
    "jq": ["PASS: t{n}", "  FAIL: t{n} x ", "PASS: t{n} x", "FAIL t{n}", "noise", "FAIL: u{n}"],
    "micropython": ["pass  a/t{n}.py", "FAIL  a/t{n}.py", "skip  a/u{n}.py", "pass a/u{n}.py", "lines", "  FAIL é{n} "],
    "googletest": ["[       OK ] S.t{n} (0 ms)", "[  FAILED  ] S.t{n} (1 ms)", "1: [ OK ] S.u{n} (a) (2 ms)", "[ RUN ] S.t{n}",
                   "[  FAILED  ] S.u{n}", "noise"],
    "minitest": ["T#test_{n}. = 0.01 s = .", "T#test_{n}. = 0.02 s = F", "T#u{n}. = 1 s = E", "T#u{n} = 1 s = .", "noise",
                 "T#u{n}. =.x"],
    "cucumber": ["feat/a{n} ...F", "feat/a{n} ....", "feat b{n} .", "noise", "x{n} F", "feat b{n} ..F-"],
    "ruby_unit": ["test: a {n}: .", "test: a {n}: F", " b{n}:  E", "b{n}: O x", "noise", "b{n}: Fx", "c: d{n}: .: E"],
    "rspec": ["A b{n} - passed", "A b{n} - failed", "A c{n} - pending", "A c{n} - x - passed", "noise", "A c{n} - x - failed"],
    "django": ["test_a{n} (mod.Case) ... ok", "test_a{n} (mod.Case) ... FAIL", "test_b{n} (m) ... skipped 'no db'",
               "ERROR: test_a{n} (mod.Case)", "test_c{n} (m) ... noise", "ok", "FAIL: test_c{n} (m)",
               "-- --version is equivalent to version", "Applying sites.0002_alter_domain_unique...test_no_migrations (x{n}) ... ok",
               "test_d{n} ... Testing against Django installed in /x silenced).\nok",
               "test_e{n} ... Internal Server Error: /p/\nok",
               "test_f{n} ... System check identified no issues (0 silenced)\nok", "  test_g{n} ...  OK  ", "test_h{n} ... ERROR"],
    "phpunit": ["Suite{n} x (App.X{n})", " ✔ does {n}", " ✘ breaks {n}", "  ↩  skips {n}", "noise (x) y", "Éa Suite (Q)", "✘ does {n}"],
    "gradle": ["a.T{n} > m PASSED", "a.T{n} > m FAILED", "a.U{n} > k", "PASSED", "> Task :x FAILED", "FAILED", "noise {n}"],
    "maven": ["+ mvn test -Dtest=T{n} -q", "[INFO] BUILD SUCCESS", "[ERROR] BUILD FAILURE", "noise", "+ mvn -Dtest=U{n}#x",
              "+ mvn -Dtest=V{n} BUILD FAILURE", "[INFO] BUILD SUCCESS "],
    "karma": ["x Starting browser C", "  Suite {n}", "    Inner {n}", "    ✔ works {n}", "      ✖ fails {n}", "SUMMARY:", "  Other"],
    "calypso": ["+ ./node_modules/.bin/jest --verbose x", "  Suite {n}", "    ✓ works {n} (3ms)", "    ✕ fails {n}",
                "Test Suites: 1", "      deeper", "noise"],
    "p5js": ["  {n}) group", "       case {n}:", "{", "}", "<a>x</a>", "  3) lone {n}:", "noise", "     next"],
    "doctest": ["<doctest binary=\"x\"><TestCase name=\"c{n}\"><SubCase name=\"s\"><Expression success=\"true\"/></SubCase></TestCase></doctest>",
                "noise"],
}

LINES_PER_LOG = {"maven": 10, "gradle": 10, "django": 10, "phpunit": 8, "karma": 10, "calypso": 10, "p5js": 8}


_SEP, _MARKS = "§", {"\n": "¶", "\x1b": "¤", "\t": "¬"}


def _log_sql(kinds: list[str], n_lines: int, extra: str = "") -> str:
    joined = _SEP.join(kinds)
    for char, mark in _MARKS.items():
        joined = joined.replace(char, mark)
    lines = [
        f"replace(split_part({q(joined)}, '{_SEP}', CAST(1 + (et + {i} * st + {i // 2}) % {len(kinds)} AS INT)), '{{n}}', n{i % 3})"
        for i in range(n_lines)
    ]
    body = f" || {NL} || ".join(lines)
    for char, mark in _MARKS.items():
        if mark in joined:
            body = f"replace({body}, '{mark}', chr({ord(char)}))"
    number = ", ".join(f"CAST((user_id + {i}) % 17 AS STRING) AS n{i}" for i in range(3))
    return (
        f"SELECT event_id AS log_id{extra}, {body} AS log FROM (SELECT event_id, user_id, "
        "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END + event_id % 3 AS et, "
        f"1 + event_id % 4 AS st, {number} FROM events) e"
    )


for _name, _kinds in TEMPLATES.items():
    view(f"v_log_{_name}", _log_sql(_kinds, LINES_PER_LOG.get(_name, 6)), texts=("log",))

# Logs of many repositories; each log holds lines of several formats and its
# repository decides which of them count.
MIXED_REPOS = [
    "pallets/flask", "psf/requests", "sphinx-doc/sphinx", "matplotlib/matplotlib", "mwaskom/seaborn", "sympy/sympy",
    "django/django", "gin-gonic/gin", "sharkdp/bat", "google/gson", "projectlombok/lombok", "apache/lucene",
    "babel/babel", "vuejs/core", "axios/axios", "diegomura/react-pdf", "markedjs/marked", "chartjs/Chart.js",
    "redis/redis", "jqlang/jq", "micropython/micropython", "fmtlib/fmt", "faker-ruby/faker", "rubocop/rubocop",
    "laravel/framework", "immutable-js/immutable-js", "jekyll/jekyll",
]
_MIXED_KINDS = [
    "PASSED t{n}", "FAILED t{n} - x", "t{n} PASSED [ 5%]", "test_a{n} ok", "test_a{n} (mod.Case) ... ok",
    "--- FAIL: T{n} (0.2s)", "test m::t{n} ... ok", "+ mvn test -Dtest=T{n} -q", "[INFO] BUILD SUCCESS", "[junit] [PASS] t{n}",
    "a.T{n} > m PASSED", "  ✓ does {n} (12 ms)", "ok {n} does {n}", "PASS pkg/t{n}.js (12.5ms)", "{n}) fails  case",
    "Chrome 12.0.{n} (Linux 0.0.0) chart {n} FAILED", "[ok]: t {n} (12 ms)", "PASS: t{n}", "pass  a/t{n}.py",
    "[       OK ] S.t{n} (0 ms)", "test: a {n}: F", "A b{n} - passed", "Suite{n} x (App.X{n})", " ✘ breaks {n}",
    "[FAILED] a {n}", "T#test_{n}. = 0.02 s = F", "feat/a{n} ....",
]
_REPO_CASE = "CASE user_id % %d " .replace("%d", str(len(MIXED_REPOS))) + " ".join(
    f"WHEN {i} THEN '{r}'" for i, r in enumerate(MIXED_REPOS)
) + " END"
_PR_CASE = "CASE event_id % 4 WHEN 0 THEN '2006' WHEN 1 THEN '2005' WHEN 2 THEN '9141' ELSE '8761' END"
view(
    "v_mixed_logs",
    _log_sql(_MIXED_KINDS, 8, f", {_REPO_CASE} AS repo, replace({_REPO_CASE}, '/', '__') || '-' || {_PR_CASE} AS instance_id"),
    texts=("repo", "instance_id", "log"),
)

# The same logs as evaluation runs leave them: results between the marks, results outside of
# them, runs that did not get so far, and repositories whose format is not known.
view(
    "v_mixed_runs",
    "SELECT log_id, CASE WHEN log_id % 7 = 3 THEN 'someone/else' ELSE repo END AS repo, instance_id, CASE "
    + f"WHEN log_id % 5 = 1 THEN log || {NL} || '>>>>> Start Test Output' || {NL} || 'noise' || {NL} || '>>>>> End Test Output' "
    + f"WHEN log_id % 5 = 2 THEN '>>>>> Start Test Output' || {NL} || log WHEN log_id % 10 = 4 THEN '>>>>> Tests Errored' || {NL} || '>>>>> Start Test Output' || log || '>>>>> End Test Output' "
    + f"ELSE 'PASSED t1' || {NL} || '>>>>> Start Test Output' || {NL} || log || {NL} || '>>>>> End Test Output' || {NL} || 'ok 1 does 1' END AS log FROM v_mixed_logs",
    texts=("repo", "instance_id", "log"),
)
view(
    "v_mixed_gold",
    "SELECT CAST(log_id AS STRING) AS instance_id, CASE WHEN log_id % 2 = 0 THEN 'FAIL_TO_PASS' ELSE 'PASS_TO_PASS' END AS category, "
    "CASE log_id % 3 WHEN 0 THEN 't' WHEN 1 THEN 'does ' ELSE 'test_a' END || CAST(log_id % 17 AS STRING) AS test FROM v_mixed_runs "
    "UNION ALL SELECT CAST(log_id AS STRING), 'FAIL_TO_PASS', 'T' || CAST(log_id % 17 AS STRING) FROM v_mixed_runs",
)
