"""Grading and reporting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.operators import grade
from patchloom.operators.logs.dispatch import language_of
from patchloom.plans import sqltext as st
from patchloom.plans.registry import query
from patchloom.plans.views import load

KEYS = ["model", "instance_id"]


def _log_status(spark, sf_dir):
    logs = load(spark, sf_dir, "v_logs")
    return grade.parse_found_logs(logs.select(*KEYS, "log"), KEYS, "pytest")


# --- SQL side of the log chain ------------------------------------------------------

_WINDOW = """
win AS (SELECT model, instance_id, repo, log,
  NOT (contains(log, '>>>>> Patch Apply Failed') OR contains(log, '>>>>> Reset Failed')
       OR contains(log, '>>>>> Tests Errored') OR contains(log, '>>>>> Tests Timed Out'))
  AND contains(log, '>>>>> Start Test Output') AND contains(log, '>>>>> End Test Output') AS found,
  split_part(split_part(log, '>>>>> Start Test Output', 2), '>>>>> End Test Output', 1) AS body FROM v_logs)"""
_PYTEST = f"""
scope AS (SELECT model, instance_id, 1 AS sc, body AS txt FROM win WHERE found
  UNION ALL SELECT model, instance_id, 2, log FROM win WHERE found),
{st.lines_cte('scope', 'model, instance_id, sc', 'txt')},
wds AS (SELECT model, instance_id, sc, line_no,
  {st.words("CASE WHEN starts_with(line, 'FAILED') THEN replace(line, ' - ', ' ') ELSE line END")} AS w
  FROM lines WHERE regexp_matches(line, '^(FAILED|PASSED|SKIPPED|ERROR|XFAIL)')),
per AS (SELECT model, instance_id, sc, w[2] AS test, arg_max(w[1], line_no) AS status FROM wds WHERE len(w) > 1 GROUP BY ALL),
best AS (SELECT model, instance_id, min(sc) AS sc FROM per GROUP BY ALL),
status AS (SELECT p.model, p.instance_id, p.test, p.status FROM per p JOIN best USING (model, instance_id, sc))"""
_GRADED = f"""{_WINDOW}, {_PYTEST},
graded AS (SELECT w.model, w.instance_id, w.repo, g.category, g.test, s.status,
  CASE WHEN w.repo IN ('chartjs/Chart.js', 'processing/p5.js', 'markedjs/marked')
    THEN CASE WHEN s.status = 'FAILED' THEN 'failure' ELSE 'success' END
    WHEN s.status IN ('PASSED', 'XFAIL') THEN 'success'
    WHEN s.status IS NULL OR s.status IN ('FAILED', 'ERROR') THEN 'failure' END AS outcome
  FROM win w JOIN v_gold g ON w.instance_id = g.instance_id
  LEFT JOIN status s ON s.model = w.model AND s.instance_id = w.instance_id AND s.test = g.test WHERE w.found)"""
_RATES = f"""{_GRADED},
cnt AS (SELECT model, instance_id,
  count(*) FILTER (category = 'FAIL_TO_PASS' AND outcome = 'success') AS f2p_success,
  count(*) FILTER (category = 'FAIL_TO_PASS' AND outcome = 'failure') AS f2p_failure,
  count(*) FILTER (category = 'PASS_TO_PASS' AND outcome = 'success') AS p2p_success,
  count(*) FILTER (category = 'PASS_TO_PASS' AND outcome = 'failure') AS p2p_failure FROM graded GROUP BY ALL),
rates AS (SELECT *, CASE WHEN f2p_success + f2p_failure = 0 THEN 1.0::DOUBLE ELSE f2p_success::DOUBLE / (f2p_success + f2p_failure) END AS f2p_rate,
  CASE WHEN p2p_success + p2p_failure = 0 THEN 1.0::DOUBLE ELSE p2p_success::DOUBLE / (p2p_success + p2p_failure) END AS p2p_rate FROM cnt)"""
_LAST = """
lastp AS (SELECT instance_id, arg_max(model_name_or_path, seq) AS model, arg_max(coalesce(model_patch, chr(0)), seq) AS p FROM v_predictions GROUP BY 1),
preds AS (SELECT instance_id, model, CASE WHEN p = chr(0) THEN NULL ELSE p END AS model_patch FROM lastp)"""
_REPORTS = f"""{_RATES}, {_LAST},
reports AS (SELECT p.model, p.instance_id, p.model_patch IS NULL AS patch_is_none, p.model_patch IS NOT NULL AS patch_exists,
  p.model_patch IS NOT NULL AND coalesce(w.found, false) AS patch_successfully_applied,
  p.model_patch IS NOT NULL AND coalesce(w.found, false) AND coalesce(r.f2p_rate, 1) = 1 AND coalesce(r.p2p_rate, 1) = 1 AS resolved
  FROM preds p LEFT JOIN win w ON w.model = p.model AND w.instance_id = p.instance_id
  LEFT JOIN rates r ON r.model = p.model AND r.instance_id = p.instance_id)"""


@query("log_window", f"WITH {_WINDOW} SELECT model, instance_id, found, CASE WHEN found THEN body END AS body FROM win")
def _(spark, sf_dir):
    return grade.log_window(load(spark, sf_dir, "v_logs")).select(*KEYS, "found", "body")


@query("log_status", f"WITH {_WINDOW}, {_PYTEST} SELECT model, instance_id, test, status FROM status")
def _(spark, sf_dir):
    return _log_status(spark, sf_dir)


def _as_it_is(df):
    return df


def _runs(spark, sf_dir, keep=_as_it_is):
    """(runs, graded tests) of all logs, from one read of them. ``keep`` may store the gold rows and those of the runs."""
    runs, status = grade.grade_logs(load(spark, sf_dir, "v_logs"), KEYS, "pytest")
    gold = keep(load(spark, sf_dir, "v_gold").select("instance_id", "category", "test"))
    return runs, grade.grade_tests(runs.filter("gradable"), gold, status, KEYS, keep)


def _graded(spark, sf_dir):
    return _runs(spark, sf_dir)[1]


@query("grade_tests", f"WITH {_GRADED} SELECT model, instance_id, category, test, status, outcome FROM graded "
       "WHERE category IN ('FAIL_TO_PASS', 'PASS_TO_PASS')")
def _(spark, sf_dir):
    g = _graded(spark, sf_dir).filter(F.col("category").isin(grade.FAIL_TO_PASS, grade.PASS_TO_PASS))
    return g.select(*KEYS, "category", "test", "status", "outcome")


@query("grade_extra", f"WITH {_GRADED} SELECT model, instance_id, category, test, status, outcome FROM graded "
       "WHERE category IN ('FAIL_TO_FAIL', 'PASS_TO_FAIL')")
def _(spark, sf_dir):
    g = _graded(spark, sf_dir).filter(F.col("category").isin(grade.FAIL_TO_FAIL, grade.PASS_TO_FAIL))
    return g.select(*KEYS, "category", "test", "status", "outcome")


@query("grade_fail_only", f"""WITH {_GRADED} SELECT model, category, count(*) FILTER (outcome = 'success') AS n_success,
  count(*) FILTER (outcome = 'failure') AS n_failure FROM graded WHERE repo IN ('chartjs/Chart.js', 'processing/p5.js', 'markedjs/marked') GROUP BY ALL""")
def _(spark, sf_dir):
    g = _graded(spark, sf_dir).filter(grade.is_fail_only(F.col("repo")))
    return g.groupBy("model", "category").agg(
        F.count_if(F.col("outcome") == "success").alias("n_success"),
        F.count_if(F.col("outcome") == "failure").alias("n_failure"),
    )


def _rates(spark, sf_dir):
    return grade.grade_rates(_graded(spark, sf_dir), KEYS)


@query("grade_rates", f"WITH {_RATES} SELECT * REPLACE (round(f2p_rate, 6) AS f2p_rate, round(p2p_rate, 6) AS p2p_rate) FROM rates")
def _(spark, sf_dir):
    r = _rates(spark, sf_dir)
    return r.withColumn("f2p_rate", F.round("f2p_rate", 6)).withColumn("p2p_rate", F.round("p2p_rate", 6))


@query("resolution", f"""WITH {_RATES} SELECT model, instance_id, CASE WHEN f2p_rate = 1 AND p2p_rate = 1 THEN 'RESOLVED_FULL'
  WHEN f2p_rate > 0 AND f2p_rate < 1 AND p2p_rate = 1 THEN 'RESOLVED_PARTIAL' ELSE 'RESOLVED_NO' END AS resolution FROM rates""")
def _(spark, sf_dir):
    return _rates(spark, sf_dir).select(*KEYS, grade.resolution(F.col("f2p_rate"), F.col("p2p_rate")).alias("resolution"))


def _preds(spark, sf_dir):
    return grade.latest_predictions(load(spark, sf_dir, "v_predictions"))


def _model_preds(spark, sf_dir):
    rows = load(spark, sf_dir, "v_predictions").select("instance_id", "seq", F.col("model_name_or_path").alias("model"), "model_patch")
    return grade.latest_predictions(rows).select(*KEYS, "model_patch")


def _reports(spark, sf_dir, preds=None, keep=_as_it_is):
    preds = _model_preds(spark, sf_dir) if preds is None else preds
    runs, graded = _runs(spark, sf_dir, keep)
    rates = keep(grade.grade_rates(keep(graded.select(*KEYS, "category", "outcome")), KEYS))
    return grade.instance_reports(preds, runs, rates, KEYS)


@query("instance_report", f"WITH {_REPORTS} SELECT * FROM reports")
def _(spark, sf_dir):
    return _reports(spark, sf_dir)


# A report exists for each prediction whose log was found; some reports are damaged.
_DAMAGED = "regexp_matches(r.instance_id, '77$')"
_STATES = f"""{_REPORTS},
onfile AS (SELECT r.instance_id, CASE WHEN {_DAMAGED} THEN NULL ELSE r.resolved END AS resolved FROM reports r WHERE r.patch_successfully_applied),
states AS (SELECT d.instance_id, CASE WHEN p.instance_id IS NULL THEN 'incomplete' WHEN coalesce(p.model_patch, '') = '' THEN 'empty_patch'
  WHEN f.instance_id IS NULL OR f.resolved IS NULL THEN 'error' WHEN f.resolved THEN 'resolved' ELSE 'unresolved' END AS state,
  p.instance_id IS NOT NULL AND coalesce(p.model_patch, '') <> '' AND f.instance_id IS NOT NULL AS completed
  FROM v_instances d LEFT JOIN preds p ON p.instance_id = d.instance_id LEFT JOIN onfile f ON f.instance_id = d.instance_id)"""


def _states(spark, sf_dir, keep=_as_it_is):
    """(states, predictions). ``keep`` may store what is large or read again."""
    preds = keep(_model_preds(spark, sf_dir))
    onfile = keep(_reports(spark, sf_dir, preds, keep).filter("patch_successfully_applied").select(
        "instance_id", F.when(~F.col("instance_id").rlike("77$"), F.col("resolved")).alias("resolved")
    ))
    return keep(grade.run_states(load(spark, sf_dir, "v_instances"), preds, onfile)), preds


@query("run_report", f"""WITH {_STATES} SELECT count(*) AS total_instances, (SELECT count(*) FROM preds) AS submitted_instances,
  count(*) FILTER (completed) AS completed_instances, count(*) FILTER (state = 'resolved') AS resolved_instances,
  count(*) FILTER (state = 'unresolved') AS unresolved_instances, count(*) FILTER (state = 'empty_patch') AS empty_patch_instances,
  count(*) FILTER (state = 'error') AS error_instances, 2 AS schema_version FROM states""")
def _(spark, sf_dir):
    return grade.run_report(*_states(spark, sf_dir))


@query("run_report_ids", f"""WITH {_STATES} SELECT state || '_ids' AS list_name, instance_id FROM states
  UNION ALL SELECT 'completed_ids', instance_id FROM states WHERE completed UNION ALL SELECT 'submitted_ids', instance_id FROM preds""")
def _(spark, sf_dir):
    return grade.run_report_ids(*_states(spark, sf_dir))


@query("progress_tally", f"""WITH {_REPORTS} SELECT model, count(*) FILTER (patch_successfully_applied AND resolved) AS n_resolved,
  count(*) FILTER (patch_successfully_applied AND NOT resolved) AS n_unresolved, count(*) FILTER (NOT patch_successfully_applied) AS n_error FROM reports GROUP BY 1""")
def _(spark, sf_dir):
    ran = F.col("patch_successfully_applied")
    return _reports(spark, sf_dir).groupBy("model").agg(
        F.count_if(ran & F.col("resolved")).alias("n_resolved"),
        F.count_if(ran & ~F.col("resolved")).alias("n_unresolved"),
        F.count_if(~ran).alias("n_error"),
    )


@query("resolution_rate", f"""WITH {_REPORTS}, j AS (SELECT r.model, i.repo, r.resolved FROM reports r JOIN v_instances i USING (instance_id))
  SELECT CASE WHEN grouping(model) = 1 THEN 'ALL' ELSE model END AS model, CASE WHEN grouping(repo) = 1 THEN 'ALL' ELSE repo END AS repo,
  count(*) AS submitted, count(*) FILTER (resolved) AS resolved, round(count(*) FILTER (resolved) / count(*), 6) AS rate
  FROM j GROUP BY ROLLUP (model, repo)""")
def _(spark, sf_dir):
    repos = load(spark, sf_dir, "v_instances").select("instance_id", "repo")
    return grade.resolution_rate(_reports(spark, sf_dir).join(repos, "instance_id"), ["model", "repo"])


@query("language_rate", f"""WITH {_REPORTS} SELECT coalesce(CASE WHEN repo IN ('django/django', 'sympy/sympy', 'pvlib/pvlib-python', 'pallets/flask', 'pyvista/pyvista') THEN 'py'
  WHEN repo IN ('chartjs/Chart.js', 'markedjs/marked') THEN 'js' WHEN repo = 'google/gson' THEN 'java' END, 'other') AS language,
  count(*) AS submitted, count(*) FILTER (resolved) AS resolved FROM reports JOIN v_instances USING (instance_id) GROUP BY 1""")
def _(spark, sf_dir):
    repos = load(spark, sf_dir, "v_instances").select(
        "instance_id", F.coalesce(language_of(F.col("repo")), F.lit("other")).alias("language"))
    return _reports(spark, sf_dir).join(repos, "instance_id").groupBy("language").agg(
        F.count(F.lit(1)).alias("submitted"), F.count_if("resolved").alias("resolved"))


@query("predictions_last_wins", f"WITH {_LAST} SELECT instance_id, model AS model_name_or_path, model_patch FROM preds")
def _(spark, sf_dir):
    return _preds(spark, sf_dir).select("instance_id", "model_name_or_path", "model_patch")


@query("predictions_gold", "SELECT instance_id, patch AS model_patch, 'gold' AS model_name_or_path FROM v_instances")
def _(spark, sf_dir):
    return grade.gold_predictions(load(spark, sf_dir, "v_instances"))


@query("work_list", f"""WITH {_LAST} SELECT i.instance_id, i.repo FROM v_instances i JOIN preds p USING (instance_id)
  WHERE coalesce(p.model_patch, '') <> '' AND i.instance_id NOT IN (SELECT instance_id FROM v_logs WHERE contains(log, 'noise'))""")
def _(spark, sf_dir):
    done = load(spark, sf_dir, "v_logs").filter(F.col("log").contains("noise"))
    return grade.work_list(
        load(spark, sf_dir, "v_instances"), _preds(spark, sf_dir), done=done, check=False
    ).select("instance_id", "repo")


@query("work_list_rewrite", f"""WITH {_LAST} SELECT i.instance_id, i.repo FROM v_instances i JOIN preds p USING (instance_id)
  WHERE i.instance_id IN (SELECT instance_id FROM v_logs WHERE contains(log, 'noise'))""")
def _(spark, sf_dir):
    logs = load(spark, sf_dir, "v_logs").filter(F.col("log").contains("noise"))
    return grade.work_list(
        load(spark, sf_dir, "v_instances"), _preds(spark, sf_dir), with_logs=logs, check=False
    ).select("instance_id", "repo")


@query("unknown_predictions", f"WITH {_LAST} SELECT instance_id FROM preds WHERE instance_id NOT IN (SELECT instance_id FROM v_instances)")
def _(spark, sf_dir):
    return grade.unknown_predictions(_preds(spark, sf_dir), load(spark, sf_dir, "v_instances")).select("instance_id")


_SIDES = """WITH b AS (SELECT model, instance_id, test, arg_max(before, seq) AS s FROM v_status GROUP BY ALL),
  a AS (SELECT model, instance_id, test, arg_max(status, seq) AS s FROM v_status WHERE status <> 'ERROR' GROUP BY ALL),
  m AS (SELECT coalesce(b.model, a.model) AS model, coalesce(b.instance_id, a.instance_id) AS instance_id, coalesce(b.test, a.test) AS test,
    CASE WHEN b.s IN ('PASSED', 'XFAIL') THEN 'PASS' WHEN b.s IS NULL OR b.s IN ('FAILED', 'ERROR') THEN 'FAIL' END AS x,
    CASE WHEN a.s IN ('PASSED', 'XFAIL') THEN 'PASS' WHEN a.s IS NULL OR a.s IN ('FAILED', 'ERROR') THEN 'FAIL' END AS y
    FROM b FULL JOIN a ON a.model = b.model AND a.instance_id = b.instance_id AND a.test = b.test),
  c AS (SELECT model, instance_id, test, x || '_TO_' || y AS category FROM m WHERE x IS NOT NULL AND y IS NOT NULL)"""


def _classes(spark, sf_dir):
    s = load(spark, sf_dir, "v_status")
    before = s.groupBy(*KEYS, "test").agg(F.max_by("before", "seq").alias("status"))
    after = s.filter("status <> 'ERROR'").groupBy(*KEYS, "test").agg(F.max_by("status", "seq").alias("status"))
    return grade.transition_classes(before, after, KEYS)


@query("transition_classes", f"{_SIDES} SELECT * FROM c")
def _(spark, sf_dir):
    return _classes(spark, sf_dir)


@query("nontrivial_instances", f"{_SIDES} SELECT model, instance_id, count(*) AS n_fail_to_pass FROM c WHERE category = 'FAIL_TO_PASS' GROUP BY ALL")
def _(spark, sf_dir):
    return grade.nontrivial(_classes(spark, sf_dir), KEYS)


_ERR_LOG = """(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || chr(10) || 'ImportError: x' WHEN 1 THEN text || ' Attribute' || chr(10) || 'fail'
  WHEN 2 THEN 'FAILED to import ' || text WHEN 3 THEN text || 'error' ELSE text END AS log FROM documents)"""


@query("import_error_flag", f"""WITH src AS {_ERR_LOG}, {st.lines_cte('src', 'doc_id')}
  SELECT doc_id, bool_or((contains(lower(line), 'attribute') OR contains(lower(line), 'import')) AND (contains(lower(line), 'error') OR contains(lower(line), 'fail'))) AS flag
  FROM lines GROUP BY 1""")
def _(spark, sf_dir):
    from patchloom.plans.views import run_sql

    docs = run_sql(spark, sf_dir, f"SELECT * FROM {_ERR_LOG} s")
    return docs.select("doc_id", grade.import_error_flag(F.col("log")).alias("flag"))


# Commands tried in order until one ends with code 0.
_ATTEMPTS = """(SELECT user_id, event_id AS ord, 'apply ' || event_type AS command, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS exit_code FROM events)"""


@query("first_success", f"""SELECT user_id, min(ord) FILTER (exit_code = 0) AS ord, arg_min(command, ord) FILTER (exit_code = 0) AS command,
  count(*) AS attempts FROM {_ATTEMPTS} a GROUP BY 1""")
def _(spark, sf_dir):
    from patchloom.plans.views import run_sql

    return grade.first_success(run_sql(spark, sf_dir, f"SELECT * FROM {_ATTEMPTS} a"), "user_id")
