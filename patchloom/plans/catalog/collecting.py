"""Collection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.operators import collect
from patchloom.plans import sqltext as st
from patchloom.plans.catalog.diffs import _FILES
from patchloom.plans.registry import query
from patchloom.plans.views import load, run_sql

_LINK = "([\\p{L}\\p{N}_]+)\\s+#([0-9]+)"
_WORDS = "('close', 'closes', 'closed', 'fix', 'fixes', 'fixed', 'resolve', 'resolves', 'resolved')"
_RESOLVED = f"""
msg AS (SELECT repo, number, string_agg(message, chr(10) ORDER BY seq) AS m FROM v_commits GROUP BY 1, 2),
txt AS (SELECT p.*, regexp_replace(coalesce(title, '') || chr(10) || coalesce(body, '') || chr(10) || coalesce(m, ''), '(?s)<!--.*?-->', '', 'g') AS t
  FROM v_pulls p LEFT JOIN msg USING (repo, number)),
ref AS (SELECT repo, number, unnest(regexp_extract_all(t, '{_LINK}', 1)) AS w, unnest(regexp_extract_all(t, '{_LINK}', 2)) AS issue FROM txt),
lnk AS (SELECT DISTINCT repo, number, issue FROM ref WHERE lower(w) IN {_WORDS}),
valid AS (SELECT p.* FROM v_pulls p WHERE merged_at IS NOT NULL AND EXISTS (SELECT 1 FROM lnk l WHERE l.repo = p.repo AND l.number = p.number)),
known AS (SELECT l.repo, l.number, l.issue, i.title, i.body, row_number() OVER (PARTITION BY l.repo, l.number ORDER BY l.issue) AS o
  FROM lnk l JOIN v_issues i ON i.repo = l.repo AND i.number = l.issue::BIGINT)"""
_STATEMENT = f"""{_RESOLVED},
stm AS (SELECT repo, number, string_agg(coalesce(title, '') || chr(10) || coalesce(body, '') || chr(10), '' ORDER BY issue) AS ps FROM known GROUP BY 1, 2)"""
_HINTS = f"""{_STATEMENT},
fc AS (SELECT repo, number, arg_min(author_date, seq) AS t FROM v_commits GROUP BY 1, 2),
pair AS (SELECT k.repo, k.number, k.issue, c.seq, c.body, bool_or(c.updated_at >= fc.t) OVER (PARTITION BY k.repo, k.number, k.issue ORDER BY c.seq) AS late
  FROM known k JOIN fc ON fc.repo = k.repo AND fc.number = k.number JOIN v_comments c ON c.repo = k.repo AND c.issue = k.issue::BIGINT),
hnt AS (SELECT * FROM pair WHERE NOT late),
per AS (SELECT repo, number, issue, string_agg(body, chr(10) ORDER BY seq) AS h FROM hnt GROUP BY ALL),
htx AS (SELECT k.repo, k.number, string_agg(coalesce(h, ''), chr(10) ORDER BY k.issue) AS hints FROM known k LEFT JOIN per p ON p.repo = k.repo AND p.number = k.number AND p.issue = k.issue GROUP BY 1, 2)"""
_INSTANCES = f"""{_HINTS}, {_FILES},
sp AS (SELECT id, coalesce(string_agg(text, '' ORDER BY file_no) FILTER (NOT regexp_matches(path, 'test|e2e')), '') AS patch,
  coalesce(string_agg(text, '' ORDER BY file_no) FILTER (regexp_matches(path, 'test|e2e')), '') AS test_patch FROM files GROUP BY 1),
ins AS (SELECT v.repo, v.number AS pull_number, replace(v.repo, '/', '__') || '-' || v.number AS instance_id,
  (SELECT string_agg(issue, ',' ORDER BY issue) FROM lnk l WHERE l.repo = v.repo AND l.number = v.number) AS issue_numbers, v.base_commit, sp.patch, sp.test_patch,
  s.ps AS problem_statement, coalesce(h.hints, '') AS hints_text, v.created_at
  FROM valid v JOIN sp ON sp.id = v.number JOIN stm s ON s.repo = v.repo AND s.number = v.number LEFT JOIN htx h ON h.repo = v.repo AND h.number = v.number
  WHERE sp.patch <> '' AND s.ps <> '')"""


def _inputs(spark, sf_dir):
    return [load(spark, sf_dir, f"v_{n}") for n in ("pulls", "commits", "issues", "comments")]


def _linked(spark, sf_dir):
    pulls, commits, _, _ = _inputs(spark, sf_dir)
    return collect.resolved_issues(pulls, commits)


@query("resolved_issues", f"""WITH {_RESOLVED} SELECT p.repo, p.number, coalesce(string_agg(l.issue, ',' ORDER BY l.issue), '') AS resolved_issues
  FROM v_pulls p LEFT JOIN lnk l ON l.repo = p.repo AND l.number = p.number GROUP BY 1, 2""")
def _(spark, sf_dir):
    return _linked(spark, sf_dir).select("repo", "number", F.array_join("resolved_issues", ",").alias("resolved_issues"))


@query("limit_pulls", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, number DESC) AS rn FROM v_pulls)
  SELECT repo, number, created_at FROM r WHERE rn <= 13""")
def _(spark, sf_dir):
    return collect.limit_pulls(load(spark, sf_dir, "v_pulls"), max_pulls=12).select("repo", "number", "created_at")


@query("limit_pulls_cutoff", """WITH r AS (SELECT *, count(*) FILTER (created_at < '1999-06-01T00:00:00Z') OVER (PARTITION BY repo ORDER BY created_at DESC, number DESC) AS old FROM v_pulls),
  s AS (SELECT *, row_number() OVER (PARTITION BY repo, created_at < '1999-06-01T00:00:00Z' ORDER BY created_at DESC, number DESC) AS rn FROM v_pulls)
  SELECT repo, number, created_at FROM s WHERE created_at >= '1999-06-01T00:00:00Z' OR rn = 1""")
def _(spark, sf_dir):
    return collect.limit_pulls(load(spark, sf_dir, "v_pulls"), cutoff="19990601").select("repo", "number", "created_at")


@query("single_pull", "SELECT repo, number, title FROM v_pulls WHERE repo = 'django/django' AND number = (SELECT max(number) FROM v_pulls WHERE repo = 'django/django')")
def _(spark, sf_dir):
    pulls = load(spark, sf_dir, "v_pulls")
    last = pulls.filter("repo = 'django/django'").agg(F.max("number")).first()[0]
    return collect.single_pull(pulls, "django/django", last).select("repo", "number", "title")


@query("valid_pulls", f"WITH {_RESOLVED} SELECT repo, number, merged_at FROM valid")
def _(spark, sf_dir):
    return collect.valid_pulls(_linked(spark, sf_dir)).select("repo", "number", "merged_at")


@query("problem_statement", f"""WITH {_STATEMENT} SELECT p.repo, p.number, coalesce(ps, '') AS problem_statement FROM v_pulls p LEFT JOIN stm USING (repo, number)""")
def _(spark, sf_dir):
    return collect.problem_statements(_linked(spark, sf_dir), load(spark, sf_dir, "v_issues"))


@query("hints_takewhile", f"WITH {_HINTS} SELECT repo, number, issue::BIGINT AS issue, seq, body FROM hnt")
def _(spark, sf_dir):
    pulls, commits, issues, comments = _inputs(spark, sf_dir)
    return collect.hint_comments(collect.resolved_issues(pulls, commits), issues, comments, commits).drop("pos")


@query("hints_text", f"WITH {_HINTS} SELECT p.repo, p.number, coalesce(hints, '') AS hints_text FROM v_pulls p LEFT JOIN htx USING (repo, number)")
def _(spark, sf_dir):
    pulls, commits, issues, comments = _inputs(spark, sf_dir)
    return collect.hints_text(collect.resolved_issues(pulls, commits), issues, comments, commits)


def _built(spark, sf_dir):
    return collect.build_instances(*_inputs(spark, sf_dir)).withColumn("issue_numbers", F.array_join("issue_numbers", ","))


@query("build_instances", f"WITH {_INSTANCES} SELECT * FROM ins")
def _(spark, sf_dir):
    return _built(spark, sf_dir)


@query("build_instances_tests", f"WITH {_INSTANCES} SELECT * FROM ins WHERE {st.strip('test_patch')} <> ''")
def _(spark, sf_dir):
    return collect.with_tests(_built(spark, sf_dir))


@query("resume_anti", "SELECT instance_id, repo FROM v_instances WHERE instance_id NOT IN (SELECT instance_id FROM v_predictions)")
def _(spark, sf_dir):
    return collect.skip_seen(load(spark, sf_dir, "v_instances"), load(spark, sf_dir, "v_predictions")).select("instance_id", "repo")


@query("collection_stats", f"""SELECT CASE WHEN grouping(repo) = 1 THEN 'ALL' ELSE repo END AS repo, count(*) AS n_instances,
  count(*) FILTER (coalesce({st.strip('test_patch')}, '') <> '') AS n_with_tests FROM v_instances GROUP BY ROLLUP (repo)""")
def _(spark, sf_dir):
    return collect.collection_stats(load(spark, sf_dir, "v_instances"))


_LINE = "instance_id || '|' || coalesce(created_at, '') || '|' || coalesce(version, '')"


@query("finetune_pool", f"""WITH l AS (SELECT instance_id, repo, test_patch, {_LINE} AS line FROM v_instances),
  e AS (SELECT {_LINE} AS line FROM v_instances WHERE version LIKE '2.%'),
  r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY md5('42:' || line), line) AS rn FROM l WHERE line NOT IN (SELECT line FROM e))
  SELECT instance_id, repo FROM r WHERE rn <= 30""")
def _(spark, sf_dir):
    rows = load(spark, sf_dir, "v_instances").select("instance_id", "repo", "test_patch", "version", F.expr(_LINE).alias("line"))
    return collect.finetune_pool(rows, rows.filter("version LIKE '2.%'"), cap=30).select("instance_id", "repo")


_ENT = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_TITLE = st.strip("regexp_replace(" + _ENT.format("regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', '', 'g')") + ", '[[:space:]\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g')")
_BODY = st.strip("regexp_replace(replace(regexp_replace(" + _ENT.format("regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '(?s)<[^>]*>', '', 'g')") + ", '\\n+', chr(10), 'g'), '    ', chr(9)), ' {2,}', ' ', 'g')")


@query("page_extract", f"SELECT page_id, {_TITLE} AS title, {_BODY} AS body FROM pages")
def _(spark, sf_dir):
    html = F.col("html")
    return load(spark, sf_dir, "pages").select(
        "page_id", collect.ticket_title(html).alias("title"), collect.ticket_body(html).alias("body"))


_STAMPED = """(SELECT repo, issue, seq, body, CASE seq % 3 WHEN 0 THEN 'See timeline at 06/15/' || substr(updated_at, 3, 2) || ' 10:11:12'
  WHEN 1 THEN 'See timeline at Jun 15, ' || substr(updated_at, 1, 4) || ', 3:04:05 PM' ELSE 'yesterday' END AS stamp FROM v_comments)"""


@query("ticket_hints", f"""WITH {_HINTS}, c AS (SELECT *, CASE seq % 3 WHEN 0 THEN strptime(substr(updated_at, 1, 10) || ' 10:11:12', '%Y-%m-%d %H:%M:%S')
    WHEN 1 THEN strptime(substr(updated_at, 1, 10) || ' 15:04:05', '%Y-%m-%d %H:%M:%S') END AS at FROM v_comments)
  SELECT k.repo, k.number, k.issue::BIGINT AS issue, c.seq, c.body AS comment, c.at FROM known k JOIN fc ON fc.repo = k.repo AND fc.number = k.number
  JOIN c ON c.repo = k.repo AND c.issue = k.issue::BIGINT WHERE c.at < strptime(fc.t, '%Y-%m-%dT%H:%M:%SZ')""")
def _(spark, sf_dir):
    pulls, commits, issues, _ = _inputs(spark, sf_dir)
    linked = collect.linked_issues(collect.resolved_issues(pulls, commits))
    known = linked.join(issues.select("repo", F.col("number").alias("issue")), ["repo", "issue"])
    first = commits.groupBy("repo", "number").agg(F.min_by("author_date", "seq").alias("first_commit"))
    return collect.ticket_hints(known, run_sql(spark, sf_dir, f"SELECT * FROM {_STAMPED} s"), first)


@query("package_links", f"""WITH t AS (SELECT page_id, url, {_TITLE} AS name, CASE page_id % 5 WHEN 0 THEN 'https://github.com/own' || page_id || '/proj' WHEN 2 THEN 'https://GitHub.com/a/b' END AS github FROM v_packages)
  SELECT row_number() OVER (ORDER BY page_id) - 1 AS rank, name, url, github, string_split(github, '/')[-2] AS owner, string_split(github, '/')[-1] AS repo FROM t""")
def _(spark, sf_dir):
    return collect.package_links(load(spark, sf_dir, "v_packages"))


@query("issue_urls", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'o' || page_id END AS owner, CASE WHEN page_id % 3 = 0 THEN 'r.x' END AS repo,
  CASE WHEN page_id % 3 = 0 THEN CAST(page_id * 7 AS VARCHAR) END AS number, CASE WHEN page_id % 3 <> 0 THEN 'not an issue url' END AS error FROM v_packages""")
def _(spark, sf_dir):
    return load(spark, sf_dir, "v_packages").select("page_id", collect.parse_issue_url(F.col("link")).alias("u")).select("page_id", "u.*")


@query("issue_text", """WITH c AS (SELECT repo, issue, string_agg(chr(10) || 'Comment: ' || body, '' ORDER BY seq) AS c FROM v_comments GROUP BY 1, 2)
  SELECT i.repo, i.number, coalesce(title, '') || chr(10) || coalesce(i.body, '') || coalesce(c, chr(10)) AS text FROM v_issues i LEFT JOIN c ON c.repo = i.repo AND c.issue = i.number""")
def _(spark, sf_dir):
    return collect.issue_texts(load(spark, sf_dir, "v_issues"), load(spark, sf_dir, "v_comments"), include_comments=True)
