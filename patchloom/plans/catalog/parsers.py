"""One query per log format, and the dispatched job over logs of all formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.operators import grade
from patchloom.operators.logs.base import ansi_strip, log_lines
from patchloom.operators.logs.dispatch import PARSERS, UNKNOWN_FORMAT, parse_test_logs, parse_with, parser_of
from patchloom.plans import sqltext as st
from patchloom.plans.log_sql import parser_sql
from patchloom.plans.log_views import MIXED_REPOS  # noqa: F401  (registers the views)
from patchloom.plans.registry import query
from patchloom.plans.views import load


def _add(name: str) -> None:
    @query(f"parse_{name}", parser_sql(name, f"v_log_{name}"))
    def _(spark, sf_dir):
        return parse_with(load(spark, sf_dir, f"v_log_{name}"), ["log_id"], name)


for _parser in PARSERS:
    _add(_parser)


# repository → format, as the checking side sees it
_FORMAT = """CASE WHEN repo = 'pallets/flask' THEN 'pytest' WHEN repo = 'psf/requests' THEN 'pytest_options' WHEN repo = 'sphinx-doc/sphinx' THEN 'pytest_v2'
  WHEN repo = 'matplotlib/matplotlib' THEN 'matplotlib' WHEN repo = 'mwaskom/seaborn' THEN 'seaborn' WHEN repo = 'sympy/sympy' THEN 'sympy'
  WHEN repo = 'django/django' THEN 'django' WHEN repo = 'gin-gonic/gin' THEN 'gotest' WHEN repo = 'sharkdp/bat' THEN 'cargo' WHEN repo = 'google/gson' THEN 'maven'
  WHEN repo = 'projectlombok/lombok' THEN 'ant' WHEN repo = 'apache/lucene' THEN 'gradle' WHEN repo = 'babel/babel' THEN 'jest' WHEN repo = 'vuejs/core' THEN 'vitest'
  WHEN repo = 'axios/axios' THEN 'tap' WHEN repo = 'diegomura/react-pdf' THEN 'react_pdf' WHEN repo = 'markedjs/marked' THEN 'marked' WHEN repo = 'chartjs/Chart.js' THEN 'chart_js'
  WHEN repo = 'redis/redis' THEN 'redis' WHEN repo = 'jqlang/jq' THEN 'jq' WHEN repo = 'micropython/micropython' THEN 'micropython' WHEN repo = 'fmtlib/fmt' THEN 'googletest'
  WHEN repo = 'faker-ruby/faker' THEN 'ruby_unit' WHEN repo = 'rubocop/rubocop' THEN 'rspec' WHEN repo = 'laravel/framework' THEN 'phpunit'
  WHEN instance_id = 'immutable-js__immutable-js-2006' THEN 'jest' WHEN instance_id = 'immutable-js__immutable-js-2005' THEN 'jest_json'
  WHEN instance_id = 'jekyll__jekyll-9141' THEN 'minitest' WHEN instance_id = 'jekyll__jekyll-8761' THEN 'cucumber' END"""
_MIXED = [
    "pytest", "pytest_options", "pytest_v2", "matplotlib", "seaborn", "sympy", "django", "gotest", "cargo", "maven", "ant", "gradle",
    "jest", "vitest", "tap", "react_pdf", "marked", "chart_js", "redis", "jq", "micropython", "googletest", "ruby_unit", "rspec",
    "phpunit", "jest_json", "minitest", "cucumber",
]


def _mixed(spark, sf_dir):
    logs = load(spark, sf_dir, "v_mixed_logs")
    return logs.withColumn("parser", parser_of(F.col("repo"), F.col("instance_id")))


@query("parse_all", "WITH f AS (SELECT log_id, log, " + _FORMAT + " AS parser FROM v_mixed_logs) " + " UNION ALL ".join(
    f"SELECT '{p}' AS parser, log_id, test, status FROM ({parser_sql(p, f'(SELECT log_id, log FROM f WHERE parser = {chr(39)}{p}{chr(39)}) q{i}')}) z{i}"
    for i, p in enumerate(_MIXED)))
def _(spark, sf_dir):
    logs = _mixed(spark, sf_dir).withColumn("fmt", F.col("parser"))
    out = parse_test_logs(logs, ["fmt", "log_id"], only=_MIXED)
    return out.select(F.col("fmt").alias("parser"), "log_id", "test", "status")


def _all_formats(table: str, column: str) -> str:
    """Status rows of every format; ``table`` has log_id, parser and the text in ``column``."""
    return " UNION ALL ".join(
        f"SELECT log_id, test, status FROM ({parser_sql(p, f'(SELECT log_id, {column} AS log FROM {table} WHERE parser = {chr(39)}{p}{chr(39)}) q_{table}_{i}')}) z_{table}_{i}"
        for i, p in enumerate(_MIXED))


_MIXED_GRADED = f"""WITH w AS (SELECT log_id, repo, log, CASE WHEN repo <> 'someone/else' THEN {_FORMAT} END AS parser, NOT (contains(log, '>>>>> Patch Apply Failed') OR contains(log, '>>>>> Reset Failed')
    OR contains(log, '>>>>> Tests Errored') OR contains(log, '>>>>> Tests Timed Out')) AND contains(log, '>>>>> Start Test Output') AND contains(log, '>>>>> End Test Output') AS found,
    split_part(split_part(log, '>>>>> Start Test Output', 2), '>>>>> End Test Output', 1) AS body FROM v_mixed_runs),
  inside AS (SELECT log_id, parser, body FROM w WHERE found), s1 AS ({_all_formats('inside', 'body')}),
  whole AS (SELECT log_id, parser, log FROM w WHERE found AND log_id NOT IN (SELECT log_id FROM s1)), s2 AS ({_all_formats('whole', 'log')}),
  status AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2),
  graded AS (SELECT g.instance_id, w.repo, g.category, g.test, s.status, CASE WHEN w.repo IN ('chartjs/Chart.js', 'processing/p5.js', 'markedjs/marked')
      THEN CASE WHEN s.status = 'FAILED' THEN 'failure' ELSE 'success' END WHEN s.status IN ('PASSED', 'XFAIL') THEN 'success'
      WHEN s.status IS NULL OR s.status IN ('FAILED', 'ERROR') THEN 'failure' END AS outcome
    FROM w JOIN v_mixed_gold g ON g.instance_id = CAST(w.log_id AS VARCHAR) LEFT JOIN status s ON s.log_id = w.log_id AND s.test = g.test
    WHERE w.found AND w.parser IS NOT NULL)"""


def _mixed_runs(spark, sf_dir):
    logs = load(spark, sf_dir, "v_mixed_runs").withColumn("parser", parser_of(F.col("repo"), F.col("instance_id")))
    runs, status = grade.grade_logs(logs.withColumn("instance_id", F.col("log_id").cast("string")), ["instance_id"])
    return runs, grade.grade_tests(runs.filter("gradable"), load(spark, sf_dir, "v_mixed_gold"), status, ["instance_id"])


@query("grade_mixed", f"{_MIXED_GRADED} SELECT instance_id, category, test, status, outcome FROM graded")
def _(spark, sf_dir):
    return _mixed_runs(spark, sf_dir)[1].select("instance_id", "category", "test", "status", "outcome")


@query("run_report_mixed", f"""{_MIXED_GRADED}, r AS (SELECT repo, count(*) AS n, count(*) FILTER (found) AS n_found, count(*) FILTER (found AND parser IS NULL) AS n_unknown_format FROM w GROUP BY 1),
  g AS (SELECT repo, count(*) FILTER (outcome = 'success') AS n_success, count(*) FILTER (outcome = 'failure') AS n_failure FROM graded GROUP BY 1)
  SELECT repo, n, n_found, n_unknown_format, coalesce(n_success, 0) AS n_success, coalesce(n_failure, 0) AS n_failure FROM r LEFT JOIN g USING (repo)""")
def _(spark, sf_dir):
    runs, graded = _mixed_runs(spark, sf_dir)
    counts = runs.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("found").alias("n_found"), F.count_if(F.coalesce(F.col("error") == UNKNOWN_FORMAT, F.lit(False))).alias("n_unknown_format"))
    tests = graded.groupBy("repo").agg(F.count_if(F.col("outcome") == "success").alias("n_success"), F.count_if(F.col("outcome") == "failure").alias("n_failure"))
    return counts.join(tests, "repo", "left").na.fill(0, ["n_success", "n_failure"])


@query("parser_dispatch", f"SELECT log_id, repo, {_FORMAT} AS parser FROM v_mixed_logs")
def _(spark, sf_dir):
    return _mixed(spark, sf_dir).select("log_id", "repo", "parser")


@query("log_lines", f"WITH {st.lines_cte('v_log_pytest', 'log_id')} SELECT log_id, CAST(line_no AS INTEGER) AS line_no, line FROM lines")
def _(spark, sf_dir):
    return log_lines(load(spark, sf_dir, "v_log_pytest"), ["log_id"])


@query("ansi_strip", "SELECT log_id, regexp_replace(log, chr(27) || '\\[[0-9;]*[A-Za-z]', '', 'g') AS log FROM v_log_chart_js")
def _(spark, sf_dir):
    return load(spark, sf_dir, "v_log_chart_js").select("log_id", ansi_strip(F.col("log")).alias("log"))
