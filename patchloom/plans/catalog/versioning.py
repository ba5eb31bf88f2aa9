"""Version queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.operators import versions
from patchloom.plans.registry import query
from patchloom.plans.views import load

# --- SQL side --------------------------------------------------------------------------

_FROM_FILES = """
pth AS (SELECT * FROM (VALUES ('django/django', 'django/__init__.py', 0), ('pallets/flask', 'src/flask/__init__.py', 0), ('pallets/flask', 'flask/__init__.py', 1),
  ('pyvista/pyvista', 'pyvista/_version.py', 0), ('pyvista/pyvista', 'pyvista/__init__.py', 1), ('sympy/sympy', 'sympy/release.py', 0), ('sympy/sympy', 'sympy/__init__.py', 1)) t(repo, path, prio)),
vf AS (SELECT f.repo, f.commit, p.prio, regexp_replace(f.content, '(?s)\"\"\".*?\"\"\"', '', 'g') AS t FROM v_files f JOIN pth p USING (repo, path)),
raw AS (SELECT repo, commit, prio, CASE WHEN repo = 'pyvista/pyvista' THEN CASE WHEN regexp_matches(t, 'version_info = [0-9]+,[0-9\\s]+,') THEN replace(regexp_extract(t, 'version_info = ([0-9]+,[0-9\\s]+,)', 1), ',', '.') END
  WHEN regexp_matches(t, '__version__ = [''\"].*[''\"]') THEN replace(regexp_extract(t, '__version__ = [''\"](.*)[''\"]', 1), ' ', '')
  WHEN regexp_matches(t, 'VERSION = \\(.*\\)') THEN replace(regexp_extract(t, 'VERSION = \\((.*)\\)', 1), ' ', '') END AS v FROM vf),
fst AS (SELECT repo, commit, arg_min(v, prio) AS v FROM raw WHERE v IS NOT NULL GROUP BY 1, 2),
two AS (SELECT repo, commit, CASE WHEN contains(v, '.') THEN array_to_string(string_split(v, '.')[1:2], '.') ELSE v END AS v FROM fst),
byfile AS (SELECT DISTINCT i.repo, i.base_commit, regexp_replace(CASE WHEN contains(t.v, ',') THEN array_to_string(string_split(t.v, ',')[1:2], '.') ELSE t.v END, '[^0-9.]', '', 'g') AS version
  FROM v_instances i JOIN two t ON t.repo = i.repo AND t.commit = i.base_commit)"""
_BYDATE = """
bydate AS (SELECT i.instance_id, i.repo, i.base_commit, i.created_at, i.version AS old, r.version FROM v_instances i
  ASOF LEFT JOIN v_releases r ON i.repo = r.repo AND substr(i.created_at, 1, 10) > r.date)"""


def _tasks(spark, sf_dir):
    return load(spark, sf_dir, "v_instances").select("instance_id", "repo", "base_commit", "created_at", "version")


def _by_file(spark, sf_dir):
    return versions.version_from_files(_tasks(spark, sf_dir), load(spark, sf_dir, "v_files"))


@query("version_from_files", f"WITH {_FROM_FILES} SELECT * FROM byfile")
def _(spark, sf_dir):
    return _by_file(spark, sf_dir)


def _asof(spark, sf_dir, fallback):
    out = versions.asof_release(_tasks(spark, sf_dir), load(spark, sf_dir, "v_releases"), fallback)
    return out.select("instance_id", "version")


@query("asof_release", f"WITH {_BYDATE} SELECT instance_id, version FROM bydate")
def _(spark, sf_dir):
    return _asof(spark, sf_dir, "null")


@query("asof_release_earliest", f"""WITH {_BYDATE}, e AS (SELECT repo, arg_min(version, date) AS v FROM v_releases GROUP BY 1)
  SELECT instance_id, coalesce(version, e.v) AS version FROM bydate LEFT JOIN e USING (repo)""")
def _(spark, sf_dir):
    return _asof(spark, sf_dir, "earliest")


@query("asof_release_keep", f"WITH {_BYDATE} SELECT instance_id, coalesce(version, old) AS version FROM bydate")
def _(spark, sf_dir):
    return _asof(spark, sf_dir, "keep")


@query("version_range_join", """WITH d AS (SELECT DISTINCT repo, substr(created_at, 1, 10) AS day FROM v_instances), c AS (SELECT repo, version, max(date) AS date FROM v_releases GROUP BY 1, 2),
  m AS (SELECT d.repo, d.day, max(c.version) AS version FROM d LEFT JOIN c ON c.repo = d.repo AND c.date < d.day GROUP BY 1, 2), lo AS (SELECT repo, min(version) AS v FROM c GROUP BY 1)
  SELECT i.instance_id, coalesce(m.version, lo.v) AS version FROM v_instances i JOIN m ON m.repo = i.repo AND m.day = substr(i.created_at, 1, 10) LEFT JOIN lo ON lo.repo = i.repo""")
def _(spark, sf_dir):
    return versions.asof_by_version(_tasks(spark, sf_dir), load(spark, sf_dir, "v_releases")).select("instance_id", "version")


@query("version_coalesce", f"""WITH {_FROM_FILES}, {_BYDATE} SELECT d.instance_id, coalesce(f.version, d.version) AS version,
  CASE WHEN f.version IS NOT NULL THEN 'files' WHEN d.version IS NOT NULL THEN 'calendar' ELSE 'none' END AS source
  FROM bydate d LEFT JOIN byfile f ON f.repo = d.repo AND f.base_commit = d.base_commit""")
def _(spark, sf_dir):
    return versions.version_coalesce(_tasks(spark, sf_dir), _by_file(spark, sf_dir), _asof(spark, sf_dir, "null"))


@query("version_groups", "SELECT repo, version, count(*) AS n, min(instance_id) AS first_id, max(instance_id) AS last_id FROM v_instances GROUP BY 1, 2")
def _(spark, sf_dir):
    return versions.version_groups(_tasks(spark, sf_dir))


@query("balanced_split", "SELECT instance_id, ntile(7) OVER (ORDER BY instance_id) - 1 AS chunk FROM v_instances")
def _(spark, sf_dir):
    return versions.balanced_split(_tasks(spark, sf_dir).select("instance_id"), ["instance_id"], 7)


_LN = "l AS (SELECT repo, unnest(string_split(html, chr(10))) AS line FROM v_release_pages)"


@query("release_calendar", f"""WITH {_LN}, a AS (SELECT DISTINCT repo, regexp_extract(line, 'nav-link( active)?\" href=\"#v([^\"]*)\">v.* \\(.*\\)</a>', 2) AS ref FROM l WHERE regexp_matches(line, 'nav-link( active)?\" href=\"#v[0-9].*\">v.* \\(.*\\)</a>'))
  SELECT DISTINCT repo, strftime(try_strptime(array_to_string(string_split(ref, '-')[4:], ' '), ['%B %d %Y', '%d %B %Y']), '%Y-%m-%d') AS date, array_to_string(string_split(ref, '-')[1:2], '.') AS version FROM a""")
def _(spark, sf_dir):
    return versions.releases_from_docs(load(spark, sf_dir, "v_release_pages"))


@query("release_changelog", f"""WITH {_LN} SELECT DISTINCT repo, regexp_extract(line, 'Version [^ ]* \\((.*)\\)</a>', 1) AS date, regexp_extract(line, '>Version ([0-9]+[.][0-9]+)', 1) AS version FROM l WHERE contains(line, 'href=\"#version-')""")
def _(spark, sf_dir):
    return versions.releases_from_changelog(load(spark, sf_dir, "v_release_pages"))


@query("release_notes", f"""WITH {_LN} SELECT DISTINCT repo, strftime(strptime(regexp_extract(line, '\\((.*)\\)</a>', 1), '%b %d, %Y'), '%Y-%m-%d') AS date, regexp_extract(line, 'whats_new_([0-9]+[.][0-9]+)', 1) AS version FROM l WHERE contains(line, 'prev_whats_new')""")
def _(spark, sf_dir):
    return versions.releases_from_notes(load(spark, sf_dir, "v_release_pages"))


@query("release_titles", """WITH t AS (SELECT repo, CASE page_id % 4 WHEN 0 THEN '0.' || (page_id % 10) WHEN 1 THEN '1.' || (page_id % 10) WHEN 2 THEN '2.' || (page_id % 5) END AS version,
    CASE WHEN page_id % 4 = 1 THEN published_at ELSE regexp_extract(name, ' - (.*)$', 1) END AS date FROM v_release_pages)
  SELECT repo, version, max(date) AS date FROM t WHERE version IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf_dir):
    return versions.releases_from_titles(load(spark, sf_dir, "v_release_pages"))
