"""Checking SQL of the log parsers, written for ``source(log_id, log)``."""

from __future__ import annotations

from patchloom.plans import sqltext as st

U = r"[\p{L}\p{N}_]"


def _coded(pattern: str, code: int, test: str, codes: dict[str, str], source: str, t: str = "") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.items())
    return f"""WITH {st.lines_cte(source, 'log_id')}, s AS (SELECT log_id, line_no, {t or st.strip('line')} AS t FROM lines),
      h AS (SELECT log_id, line_no, regexp_extract(t, '{pattern}', {code}) AS code, {test} AS test FROM s WHERE regexp_matches(t, '{pattern}'))
      SELECT log_id, test, arg_max(CASE code {whens} END, line_no) AS status FROM h
      WHERE code IN ({', '.join(repr(k) for k in codes)}) GROUP BY 1, 2"""


def _x(pattern: str, i: int) -> str:
    return f"regexp_extract(t, '{pattern}', {i})"


CODED = {
    "gotest": (r"^--- (PASS|FAIL|SKIP): (.+) \(.+\)$", 1, 2, {"PASS": "PASSED", "FAIL": "FAILED", "SKIP": "SKIPPED"}),
    "cargo": (rf"^test\s+(\S+)\s+[.][.][.]\s+({U}+)$", 2, 1, {"ok": "PASSED", "FAILED": "FAILED"}),
    "ant": (r"^\[junit\]\s+\[(PASS|FAIL|ERR)\]\s+(.*)$", 1, 2, {"PASS": "PASSED", "FAIL": "FAILED", "ERR": "FAILED"}),
    "jest": (r"^(✓|✕|○)\s(.+?)(\s\(\d+\s*m?s\))?$", 1, 2, {"✓": "PASSED", "✕": "FAILED", "○": "SKIPPED"}),
    "jest_json": (r"^\[(PASSED|FAILED)\]\s(.+)$", 1, 2, {"PASSED": "PASSED", "FAILED": "FAILED"}),
    "vitest": (r"^(✓|×|↓)\s(.+?)(\s(\d+\s*m?s?|\[skipped\]))?$", 1, 2, {"✓": "PASSED", "×": "FAILED", "↓": "SKIPPED"}),
    "tap": (r"^(ok|not ok) \d+ (.+)$", 1, 2, {"ok": "PASSED", "not ok": "FAILED"}),
    "redis": (r"^\[(ok|err|skip|ignore)\]:\s(.+?)(\s\(\d+\s*m?s\))?$", 1, 2,
              {"ok": "PASSED", "err": "FAILED", "skip": "SKIPPED", "ignore": "SKIPPED"}),
    "jq": (r"^(PASS|FAIL):\s(.+)$", 1, 2, {"PASS": "PASSED", "FAIL": "FAILED"}),
    "micropython": (r"^(pass|FAIL|skip)\s+(.+)$", 1, 2, {"pass": "PASSED", "FAIL": "FAILED", "skip": "SKIPPED"}),
    "googletest": (r"^.*\[\s*(OK|FAILED)\s*\]\s(.*)\s\(.*\)$", 1, 2, {"OK": "PASSED", "FAILED": "FAILED"}),
    "minitest": (r"^(.+)[.] .*=.*([.]|F|E).*$", 2, 1, {".": "PASSED", "F": "FAILED", "E": "FAILED"}),
    "cucumber": (r"^(.*) [.]+([.]|F)", 2, 1, {".": "PASSED", "F": "FAILED"}),
    "ruby_unit": (r"^(test: )?(.+):\s+([.]|E\b|F\b|O\b)", 3, 2, {".": "PASSED", "E": "FAILED", "F": "FAILED", "O": "SKIPPED"}),
    "rspec": (r"^(.+) - (passed|failed)", 2, 1, {"passed": "PASSED", "failed": "FAILED"}),
}

_STATUS = "(FAILED|PASSED|SKIPPED|ERROR|XFAIL)"


def _pytest(source: str, line: str = "line", test: str = "w[2]") -> str:
    return f"""WITH {st.lines_cte(source, 'log_id')}, s AS (SELECT log_id, line_no, {line} AS t FROM lines),
      h AS (SELECT log_id, line_no, {st.words("CASE WHEN starts_with(t, 'FAILED') THEN replace(t, ' - ', ' ') ELSE t END")} AS w
        FROM s WHERE regexp_matches(t, '^{_STATUS}')),
      g AS (SELECT log_id, line_no, {test} AS test, w[1] AS status FROM h WHERE len(w) > 1)
      SELECT log_id, test, arg_max(status, line_no) AS status FROM g GROUP BY 1, 2"""


_OPTION = r"""CASE WHEN regexp_matches(w[2], '\[.*\]') THEN
   regexp_extract(w[2], '^([^\[]*)\[(.*)\]', 1) || '[' || CASE WHEN regexp_matches(regexp_extract(w[2], '^[^\[]*\[(.*)\]', 1), '^/([^/*][^*]*)?$')
     THEN '/' || regexp_extract(regexp_extract(w[2], '^[^\[]*\[(.*)\]', 1), '([^/]*)$', 1) ELSE regexp_extract(w[2], '^[^\[]*\[(.*)\]', 1) END || ']'
   ELSE w[2] END"""


def parser_sql(name: str, source: str) -> str | None:
    """SQL giving (log_id, test, status), or None for formats checked by tests only."""
    if name in CODED:
        pattern, code, test, codes = CODED[name]
        expr = _x(pattern, test)
        if name == "redis":
            expr = f"CASE WHEN {_x(pattern, code)} = 'err' THEN regexp_replace({expr}, '\\s+in\\s+\\S+$', '') ELSE {expr} END"
        return _coded(pattern, code, expr, codes, source)
    lines = st.lines_cte(source, "log_id")
    if name == "pytest":
        return _pytest(source)
    if name == "pytest_options":
        return _pytest(source, test=_OPTION)
    if name == "matplotlib":
        return _pytest(source, line="replace(replace(line, 'MouseButton.LEFT', '1'), 'MouseButton.RIGHT', '3')")
    if name == "pytest_v2":
        return f"""WITH {lines}, s AS (SELECT log_id, line_no, regexp_replace(regexp_replace(line, '\\[\\d+m', '', 'g'), '[\\x01-\\x1f]', '', 'g') AS t FROM lines),
          h AS (SELECT log_id, line_no, {st.words("CASE WHEN starts_with(t, 'FAILED') THEN replace(t, ' - ', ' ') ELSE t END")} AS w,
            regexp_matches(t, '^{_STATUS}') AS head FROM s WHERE regexp_matches(t, '^{_STATUS}') OR regexp_matches(t, '{_STATUS}$'))
          SELECT log_id, CASE WHEN head THEN w[2] ELSE w[1] END AS test, arg_max(CASE WHEN head THEN w[1] ELSE w[2] END, line_no) AS status
          FROM h WHERE len(w) > 1 GROUP BY 1, 2"""
    if name == "seaborn":
        return f"""WITH {lines}, s AS (SELECT log_id, line_no, line, {st.words('line')} AS w FROM lines),
          h AS (SELECT log_id, line_no, CASE WHEN line LIKE 'FAILED%' THEN w[2] WHEN contains(line, ' PASSED ') THEN CASE WHEN w[2] = 'PASSED' THEN w[1] END
            WHEN line LIKE 'PASSED%' THEN w[2] END AS test, CASE WHEN line LIKE 'FAILED%' THEN 'FAILED' ELSE 'PASSED' END AS status FROM s)
          SELECT log_id, test, arg_max(status, line_no) AS status FROM h WHERE test IS NOT NULL GROUP BY 1, 2"""
    if name == "sympy":
        p = r"_* (.*)[.]py:(.*) _*"
        return f"""WITH {lines}, s AS (SELECT log_id, line_no, line, {st.strip('line')} AS t FROM lines),
          h AS (SELECT log_id, line_no, regexp_extract(line, '{p}', 1) || '.py:' || regexp_extract(line, '{p}', 2) AS test, 'FAILED' AS status FROM s WHERE regexp_matches(line, '{p}')
            UNION ALL SELECT log_id, 1000000 + line_no, regexp_extract(t, '^(\\S+)', 1), CASE regexp_extract(t, ' (E|F|ok)$', 1) WHEN 'E' THEN 'ERROR' WHEN 'F' THEN 'FAILED' ELSE 'PASSED' END
            FROM s WHERE regexp_matches(t, '^test_.* (E|F|ok)$'))
          SELECT log_id, test, arg_max(status, line_no) AS status FROM h GROUP BY 1, 2"""
    if name == "marked":
        return f"""WITH {lines} SELECT DISTINCT log_id, {st.strip("regexp_extract(line, '^[0-9]+[)][[:space:]](.*)', 1)")} AS test, 'FAILED' AS status
          FROM lines WHERE regexp_matches(line, '^[0-9]+[)][[:space:]]')"""
    if name == "react_pdf":
        return f"""WITH {lines}, h AS (SELECT log_id, line_no, line[1:4] AS code,
            CASE WHEN regexp_matches(line, '^(PASS|FAIL)\\s.*\\s\\([\\d.]+(ms|\\ss|s)\\)') THEN
              coalesce(nullif(regexp_extract(line, '^(PASS|FAIL)\\s(.*)\\s\\([\\d.]+ms\\)', 2), ''), nullif(regexp_extract(line, '^(PASS|FAIL)\\s(.*)\\s\\([\\d.]+\\ss\\)', 2), ''),
                regexp_extract(line, '^(PASS|FAIL)\\s(.*)\\s\\([\\d.]+s\\)', 2)) ELSE regexp_extract(line, '^(PASS|FAIL)\\s(.*)', 2) END AS test
            FROM lines WHERE regexp_matches(line, '^(PASS|FAIL)\\s'))
          SELECT log_id, test, arg_max(CASE code WHEN 'PASS' THEN 'PASSED' ELSE 'FAILED' END, line_no) AS status FROM h GROUP BY 1, 2"""
    if name == "chart_js":
        return f"""WITH s AS (SELECT log_id, string_split(regexp_replace(log, '\\x1b(\\[[0-?]*[ -/]*[@-~]|[@-Z\\\\-_])', '', 'g'), chr(10)) AS ls FROM {source}),
          l AS (SELECT log_id, unnest(ls) AS line FROM s)
          SELECT DISTINCT log_id, regexp_extract(line, 'Chrome\\s[\\d.]+[^\\S\\r\\n]\\(.+?\\)[^\\S\\r\\n](.*)FAILED$', 1) AS test, 'FAILED' AS status
          FROM l WHERE regexp_matches(line, 'Chrome\\s[\\d.]+[^\\S\\r\\n]\\(.+?\\)[^\\S\\r\\n](.*)FAILED$')"""
    if name == "phpunit":
        return f"""WITH {lines}, s AS (SELECT *, CASE WHEN regexp_matches(line, '^{U}.+ \\(.+\\)$') THEN regexp_extract(line, '^({U}.+) \\(.+\\)$', 1) END AS suite FROM lines),
          c AS (SELECT *, last_value(suite IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY line_no) AS cur FROM s),
          h AS (SELECT log_id, line_no, coalesce(cur, 'None') || ' > ' || regexp_extract(line, '^\\s*(✔|✘|↩)\\s*(.*)$', 2) AS test, regexp_extract(line, '^\\s*(✔|✘|↩)', 1) AS code
            FROM c WHERE suite IS NULL AND regexp_matches(line, '^\\s*(✔|✘|↩)'))
          SELECT log_id, test, arg_max(CASE code WHEN '✔' THEN 'PASSED' WHEN '✘' THEN 'FAILED' ELSE 'SKIPPED' END, line_no) AS status FROM h GROUP BY 1, 2"""
    if name == "gradle":
        return f"""WITH RECURSIVE {lines}, s AS (SELECT log_id, line_no, {st.strip('line')} AS t FROM lines),
          sim AS (SELECT log_id, -1::BIGINT AS line_no, NULL::VARCHAR AS pend, NULL::VARCHAR AS test, NULL::VARCHAR AS status FROM (SELECT DISTINCT log_id FROM s)
            UNION ALL SELECT s.log_id, s.line_no,
              CASE WHEN regexp_matches(t, '^[^>].+\\s+(PASSED|FAILED)$') THEN NULL WHEN regexp_matches(t, '^[^>]\\S*\\s+>\\s+\\S+$') THEN t
                WHEN t IN ('PASSED', 'FAILED') THEN NULL ELSE pend END,
              CASE WHEN regexp_matches(t, '^[^>].+\\s+(PASSED|FAILED)$') THEN regexp_extract(t, '^([^>].+)\\s+(PASSED|FAILED)$', 1) WHEN t IN ('PASSED', 'FAILED') THEN pend END,
              CASE WHEN regexp_matches(t, '^[^>].+\\s+(PASSED|FAILED)$') THEN regexp_extract(t, '(PASSED|FAILED)$', 1) WHEN t IN ('PASSED', 'FAILED') AND pend IS NOT NULL THEN t END
            FROM sim JOIN s ON s.log_id = sim.log_id AND s.line_no = sim.line_no + 1)
          SELECT log_id, test, arg_max(status, line_no) AS status FROM sim WHERE test IS NOT NULL GROUP BY 1, 2"""
    if name == "maven":
        return f"""WITH RECURSIVE {lines}, s AS (SELECT log_id, line_no, {st.strip('line')} AS t FROM lines),
          e AS (SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY line_no, pos) AS i, test, res FROM (
            SELECT log_id, line_no, 0 AS pos, regexp_extract(t, '^.*-Dtest=(\\S+).*$', 1) AS test, NULL AS res FROM s WHERE regexp_matches(t, '-Dtest=\\S')
            UNION ALL SELECT log_id, line_no, 1, NULL, CASE WHEN t LIKE '%SUCCESS' THEN 'PASSED' ELSE 'FAILED' END FROM s WHERE regexp_matches(t, 'BUILD (SUCCESS|FAILURE)$')) x),
          sim AS (SELECT log_id, 0::BIGINT AS i, []::VARCHAR[] AS pend, []::VARCHAR[] AS spare, []::VARCHAR[] AS tests, []::VARCHAR[] AS res FROM (SELECT DISTINCT log_id FROM s)
            UNION ALL SELECT e.log_id, e.i, CASE WHEN e.test IS NOT NULL THEN list_append(pend, e.test) ELSE pend[2:] END,
              CASE WHEN e.test IS NULL AND len(pend) = 0 THEN list_append(spare, e.res) ELSE spare END,
              CASE WHEN e.test IS NULL AND len(pend) > 0 THEN list_append(tests, pend[1]) ELSE tests END,
              CASE WHEN e.test IS NULL AND len(pend) > 0 THEN list_append(sim.res, e.res) ELSE sim.res END
            FROM sim JOIN e ON e.log_id = sim.log_id AND e.i = sim.i + 1),
          fin AS (SELECT log_id, arg_max(tests || pend[1:least(len(pend), len(spare))], i) AS tests, arg_max(res || spare[1:least(len(pend), len(spare))], i) AS res FROM sim GROUP BY 1),
          p AS (SELECT log_id, unnest(tests) AS test, unnest(res) AS status, generate_subscripts(tests, 1) AS nr FROM fin)
          SELECT log_id, test, arg_max(status, nr) AS status FROM p GROUP BY 1, 2"""
    if name == "django":
        def rule(cond: str, test: str, status: str, pos: int) -> str:
            return f"SELECT log_id, line_no * 10 + {pos} AS o, {test} AS test, '{status}' AS status FROM c WHERE {cond}"

        multi = [
            r"(?m)^(.*?)\s[.][.][.]\sTesting against Django installed in (?s:.*?) silenced\)[.]\nok$",
            r"(?m)^(.*?)\s[.][.][.]\sInternal Server Error: /(?:.*)/\nok$",
            r"(?m)^(.*?)\s[.][.][.]\sSystem check identified no issues \(0 silenced\)\nok$",
        ]
        rules = [
            rule("contains(t, '--version is equivalent to version')", "'--version is equivalent to version'", "PASSED", 0),
            rule("regexp_matches(t, ' [.][.][.] (ok| ?OK)$')", "regexp_replace(u, ' [.][.][.] (ok| ?OK)$', '')", "PASSED", 1),
            rule("contains(u, ' ... skipped')", "split_part(u, ' ... skipped', 1)", "SKIPPED", 2),
            rule("suffix(u, ' ... FAIL')", "split_part(u, ' ... FAIL', 1)", "FAILED", 3),
            rule("prefix(u, 'FAIL:')", "regexp_extract(u, '^\\S+\\s+(\\S+)', 1)", "FAILED", 4),
            rule("suffix(u, ' ... ERROR')", "split_part(u, ' ... ERROR', 1)", "ERROR", 5),
            rule("prefix(u, 'ERROR:')", "regexp_extract(u, '^\\S+\\s+(\\S+)', 1)", "ERROR", 6),
            rule("prefix(u, 'ok') AND prev IS NOT NULL", "prev", "PASSED", 7),
        ] + [
            f"SELECT log_id, 100000000 AS o, unnest(regexp_extract_all(log, '{m}', 1)) AS test, 'PASSED' AS status FROM {source}" for m in multi
        ]
        return f"""WITH {lines}, s AS (SELECT log_id, line_no, {st.strip('line')} AS t FROM lines),
          c AS (SELECT log_id, line_no, t, CASE WHEN regexp_matches(t, ' [.][.][.] (ok| ?OK)$') AND prefix(t, 'Applying sites.0002_alter_domain_unique...test_no_migrations')
              THEN {st.strip("t[strpos(t, '...') + 3:]")} ELSE t END AS u,
            last_value(CASE WHEN contains(t, ' ... ') THEN split_part(t, ' ... ', 1) END IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY line_no) AS prev FROM s),
          h AS ({' UNION ALL '.join(rules)})
          SELECT log_id, test, arg_max(status, o) AS status FROM h GROUP BY 1, 2"""
    return None
