"""Curation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.operators import curate, diffs
from patchloom.plans import sqltext as st
from patchloom.plans.catalog.diffs import _FILES
from patchloom.plans.registry import query
from patchloom.plans.views import load, run_sql, view

# Instances whose statements come from the documents.
view("v_lite", """SELECT 'd-' || CAST(t.doc_id AS STRING) AS instance_id, r.repo, t.text AS problem_statement, t.doc_id AS id
  FROM v_text t JOIN v_repo r ON t.doc_id % 25 = r.n_nationkey""")
view("v_issue_ids", "SELECT repo, number FROM v_issues")

_HASH = "(regexp_matches({t}, '(^|[^/\\p{L}\\p{N}_])[0-9a-f]{40}([^\\p{L}\\p{N}_]|$)') OR regexp_matches({t}, '\\[[0-9a-f]{23}\\]'))"
_SUFFIX = "png|jpg|jpeg|gif|bmp|tiff|svg|webp|ico|heif|bpg|avif|mp4|avi|mkv|mov|wmv|flv|webm|mpeg"


def _flag_sql(t: str) -> dict[str, str]:
    return {
        "has_hash": _HASH.replace("{t}", t),
        "has_link": f"regexp_matches({t}, 'https?://.|www[.].')",
        "has_image": f"regexp_matches({t}, '(?i)[\\p{{L}}\\p{{N}}_][.]({_SUFFIX})([^\\p{{L}}\\p{{N}}_]|$)')",
        "is_short": f"len({st.words(t)}) <= 40",
    }


_FLAGS = ", ".join(f"{sql} AS {name}" for name, sql in _flag_sql("text").items())
_REF = f"""ref AS (SELECT i.instance_id, i.repo, unnest(regexp_extract_all(problem_statement, '#([0-9]+)', 1)) AS n FROM v_lite i),
  kw AS (SELECT instance_id, len(list_filter(regexp_extract_all(problem_statement, '([\\p{{L}}\\p{{N}}_]+)\\s+#[0-9]+', 1), lambda w: lower(w) IN ('close', 'closes', 'closed', 'fix', 'fixes', 'fixed', 'resolve', 'resolves', 'resolved'))) > 0
    OR regexp_matches(problem_statement, 'https?://gitlab.com/.*/issues') AS hit FROM v_lite),
  isr AS (SELECT i.instance_id, kw.hit OR EXISTS (SELECT 1 FROM ref r JOIN v_issue_ids s ON s.repo = r.repo AND s.number = r.n::BIGINT WHERE r.instance_id = i.instance_id) AS has_issue_ref
    FROM v_lite i JOIN kw USING (instance_id))"""
_PATCH = f"""{_FILES}, pf AS (SELECT id, bool_or(kind <> 'modified') AS adds_or_removes, sum(n_added + n_removed) <= 25 AS few_lines, count(*) FILTER (kind = 'modified') <= 1 AS few_files,
  coalesce(sum(n_hunks) FILTER (kind = 'modified'), 0) BETWEEN 1 AND 3 AS few_hunks FROM files GROUP BY 1)"""


@query("lite_flags", f"SELECT doc_id, {_FLAGS} FROM v_text")
def _(spark, sf_dir):
    return load(spark, sf_dir, "v_text").select("doc_id", *curate.statement_flags(F.col("text"), F.lit("a/b")))


@query("lite_plain_link", "SELECT doc_id, regexp_matches(text, 'https?://[^[:space:]]') AS has_link FROM v_text")
def _(spark, sf_dir):
    return load(spark, sf_dir, "v_text").select("doc_id", curate.has_hyperlink(F.col("text")).alias("has_link"))


@query("lite_own_link", """SELECT doc_id, regexp_matches(CASE doc_id % 3 WHEN 0 THEN 'at http://github.com/a/b/pull/1' WHEN 1 THEN text ELSE 'x' END, 'https?://[^g]|www[.].') AS has_link FROM v_text""")
def _(spark, sf_dir):
    t = F.expr("CASE doc_id % 3 WHEN 0 THEN 'at http://github.com/a/b/pull/1' WHEN 1 THEN text ELSE 'x' END")
    return load(spark, sf_dir, "v_text").select("doc_id", curate.has_hyperlink(t, F.lit("a/b"), exclude_own_repo=True).alias("has_link"))


@query("lite_issue_ref", f"WITH {_REF} SELECT * FROM isr")
def _(spark, sf_dir):
    return curate.issue_reference(load(spark, sf_dir, "v_lite"), load(spark, sf_dir, "v_issue_ids")).select("instance_id", "has_issue_ref")


def _files(spark, sf_dir):
    return diffs.diff_files(diffs.diff_lines(load(spark, sf_dir, "v_diffs").select("id", "patch")))


@query("lite_patch_flags", f"WITH {_PATCH} SELECT * FROM pf")
def _(spark, sf_dir):
    return curate.patch_flags(_files(spark, sf_dir))


@query("lite_message_flag", """SELECT id, CASE WHEN regexp_matches(p, 'pytest[.](raises|warns|deprecated_call)') THEN contains(p, 'match') ELSE regexp_matches(p, 'assertOutput|assertRaises|checks[.]Error') END AS expects_message
  FROM (SELECT id, CASE id % 3 WHEN 0 THEN patch WHEN 1 THEN replace(patch, 'match=', '') ELSE replace(patch, 'pytest', 'assertRaises') END AS p FROM v_diffs WHERE patch IS NOT NULL)""")
def _(spark, sf_dir):
    d = run_sql(spark, sf_dir, """SELECT id, CASE id % 3 WHEN 0 THEN patch WHEN 1 THEN replace(patch, 'match=', '')
      ELSE replace(patch, 'pytest', 'assertRaises') END AS p FROM v_diffs WHERE patch IS NOT NULL""")
    return d.select("id", curate.expects_message(F.col("p")).alias("expects_message"))


# Lite instances pair the statement of a document with the diff of the order of that number.
view("v_lite_instances", """SELECT l.instance_id, l.repo, l.problem_statement, d.patch,
  CASE WHEN l.id % 4 = 0 THEN d.patch ELSE '' END AS test_patch FROM v_lite l JOIN v_diffs d ON d.id = l.id""", texts=("problem_statement", "patch", "test_patch"))
_LITE = f"""{_REF}, {_PATCH},
  ok AS (SELECT i.instance_id, NOT ({_flag_sql('i.problem_statement')['is_short']} OR {_flag_sql('i.problem_statement')['has_link']} OR isr.has_issue_ref OR {_flag_sql('i.problem_statement')['has_hash']} OR {_flag_sql('i.problem_statement')['has_image']}) AS statement_ok,
    coalesce(NOT pf.adds_or_removes AND pf.few_files AND pf.few_hunks, false) AS patch_ok,
    NOT coalesce(CASE WHEN regexp_matches(i.test_patch, 'pytest[.](raises|warns|deprecated_call)') THEN contains(i.test_patch, 'match') ELSE regexp_matches(i.test_patch, 'assertOutput|assertRaises|checks[.]Error') END, false) AS test_ok
    FROM v_lite_instances i JOIN isr ON isr.instance_id = i.instance_id LEFT JOIN pf ON i.instance_id = 'd-' || pf.id)"""


def _lite(spark, sf_dir):
    inst = load(spark, sf_dir, "v_lite_instances")
    files = diffs.diff_files(diffs.diff_lines(inst.select("instance_id", "patch"), "instance_id"), "instance_id")
    return curate.lite_flags(inst, load(spark, sf_dir, "v_issue_ids"), files)


@query("lite_funnel", f"""WITH {_LITE} SELECT count(*) AS n_start, count(*) FILTER (statement_ok) AS n_statement, count(*) FILTER (statement_ok AND patch_ok) AS n_patch,
  count(*) FILTER (statement_ok AND patch_ok AND test_ok) AS n_test FROM ok""")
def _(spark, sf_dir):
    return curate.lite_funnel(_lite(spark, sf_dir))


@query("lite_filter", f"WITH {_LITE} SELECT instance_id FROM ok WHERE statement_ok AND patch_ok AND test_ok")
def _(spark, sf_dir):
    return curate.lite_filter(_lite(spark, sf_dir)).select("instance_id")


@query("lite_sample", "SELECT instance_id, repo FROM v_instances ORDER BY md5('42:' || instance_id), instance_id LIMIT 300")
def _(spark, sf_dir):
    return curate.take_subset(load(spark, sf_dir, "v_instances").select("instance_id", "repo"), 300)
