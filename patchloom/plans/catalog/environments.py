"""Environment and specification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.operators import envs
from patchloom.plans import sqltext as st
from patchloom.plans.registry import query
from patchloom.plans.views import NL, load, run_sql, text_lines, view

_SCRIPT = "(SELECT instance_id, 'create ' || version || chr(10) || 'install ' || repo AS script FROM v_instances)"
_PRESENT = "SELECT DISTINCT substr(sha256(script), 1, 22) AS env_key FROM {s} s WHERE script LIKE 'create 2.%'"


def _scripts(spark, sf_dir):
    return run_sql(spark, sf_dir, f"SELECT * FROM {_SCRIPT} s").withColumn("env_key", envs.env_key(F.col("script")))


@query("env_groups", f"SELECT substr(sha256(script), 1, 22) AS env_key, count(*) AS n, min(instance_id) AS first_id FROM {_SCRIPT} s WHERE script NOT LIKE 'create 2.%' GROUP BY 1")
def _(spark, sf_dir):
    rows = _scripts(spark, sf_dir)
    return envs.env_groups(rows, existing=rows.filter("script LIKE 'create 2.%'").select("env_key").distinct())


@query("pending_keys", f"""SELECT instance_id, substr(sha256(script), 1, 22) AS env_key FROM {_SCRIPT} s WHERE script NOT LIKE 'create 2.%' AND instance_id IN (SELECT instance_id FROM v_hits)""")
def _(spark, sf_dir):
    rows = _scripts(spark, sf_dir)
    done = rows.filter("script LIKE 'create 2.%'").select("env_key").distinct()
    return envs.pending_keys(rows, load(spark, sf_dir, "v_hits"), done).select("instance_id", "env_key")


# Requirement texts, one per snapshot row of the orders, with includes and comments.
_PKG = "CASE k % 7 WHEN 0 THEN 'types-pkg_resources' WHEN 1 THEN 'types-pkg_resources==1.0' WHEN 2 THEN 'types-pkg_resources>=0.1' WHEN 3 THEN 'xtypes-pkg_resources' WHEN 4 THEN 'types-pkg_resources ' WHEN 5 THEN 'types-pkg_resources~=2' ELSE 'types-pkg_resources2' END"
view(
    "v_requirements",
    "SELECT repo, 'c' || CAST(k AS STRING) AS commit, CASE k % 2 WHEN 0 THEN 'req/dev.txt' ELSE 'dev.txt' END AS path, "
    + text_lines(
        "'# head'", _PKG, "'numpy>=1.' || CAST(k % 9 AS STRING)", "'-r base.txt'", "'  -e .'", "'-e .[dev]'", "'.[test]'", "' types-pkg_resources'",
        "CASE k % 3 WHEN 0 THEN '-r missing.txt' ELSE 'pandas' END", "'scipy # why'",
    ) + " AS text FROM v_work UNION ALL SELECT repo, 'c' || CAST(k AS STRING) AS commit, CASE k % 2 WHEN 0 THEN 'req/base.txt' ELSE 'base.txt' END AS path, "
    + text_lines("'six'", "'# no'", "'attrs==' || CAST(k % 5 AS STRING)") + " || '-r deeper.txt' AS text FROM v_work",
    texts=("text",),
)


@query("clean_requirements", f"""WITH {st.lines_cte('v_requirements', 'repo, commit, path', 'text')}
  SELECT repo, commit, path, string_agg(regexp_replace(line, '^types-pkg_resources([<>=!~].*|$)', 'types-setuptools'), chr(10) ORDER BY line_no) AS text FROM lines GROUP BY 1, 2, 3""")
def _(spark, sf_dir):
    return load(spark, sf_dir, "v_requirements").select("repo", "commit", "path", envs.clean_requirements(F.col("text")).alias("text"))


@query("flatten_requirements", f"""WITH {st.lines_cte('v_requirements', 'repo, commit, path', 'text')},
  k AS (SELECT *, trim(line) AS t, path LIKE '%dev.txt' AS root FROM lines),
  own AS (SELECT repo, commit, string_agg(line, chr(10) ORDER BY line_no) AS o FROM k WHERE root AND NOT regexp_matches(t, '^(-r|-e [.]|#|[.]\\[test)') GROUP BY 1, 2),
  inc AS (SELECT repo, commit, string_agg(line, chr(10) ORDER BY line_no) AS e FROM k WHERE NOT root AND NOT regexp_matches(t, '^(-e [.]|#|[.]\\[test)') GROUP BY 1, 2)
  SELECT repo, commit, e || chr(10) || o AS text FROM own JOIN inc USING (repo, commit)""")
def _(spark, sf_dir):
    files = load(spark, sf_dir, "v_requirements")
    return envs.flatten_requirements(files.filter("path LIKE '%dev.txt'"), files)


view(
    "v_env_files",
    "SELECT repo, CAST(k AS STRING) AS commit, k, CASE k % 3 WHEN 0 THEN 'environment.yml' WHEN 1 THEN 'ci/requirements/environment.yml' ELSE 'other.yml' END AS path, "
    + text_lines("'name: xarray-tests'", "'channels:'", "'  - conda-forge'", "'dependencies:'", "'  - types-pkg_resources'")
    + " || CASE k % 5 WHEN 0 THEN '' ELSE "
    + text_lines("'  - pip:'", "'    - types-pkg_resources==0.1.' || CAST(k % 4 AS STRING)", "'    - numpy'", "''", "'    - types-pkg_resources'",
                 "'    - types-pkg_resources-x'")
    + " END || CASE k % 4 WHEN 0 THEN '' ELSE " + text_lines("'  - types-pkg_resources>=3'", "'prefix: x'") + " END AS content FROM v_work",
    texts=("path", "content"),
)


@query("clean_env_yml", f"""WITH {st.lines_cte('v_env_files', 'k', 'content')}, p AS (SELECT k, min(line_no) FILTER (regexp_matches(line, '^\\s*-\\s*pip\\s*:\\s*$')) AS pip FROM lines GROUP BY 1),
  m AS (SELECT l.*, p.pip, min(l.line_no) FILTER (l.line_no > p.pip AND trim(line) <> '' AND NOT regexp_matches(line, '^   ')) OVER (PARTITION BY l.k) AS stop FROM lines l JOIN p USING (k))
  SELECT k, string_agg(CASE WHEN line_no > pip AND (stop IS NULL OR line_no < stop) THEN regexp_replace(line, '^(\\s*-\\s*)types-pkg_resources([<>=!~].*|$)', '\\1types-setuptools') ELSE line END, chr(10) ORDER BY line_no) AS content FROM m GROUP BY 1""")
def _(spark, sf_dir):
    return load(spark, sf_dir, "v_env_files").select("k", envs.clean_environment(F.col("content")).alias("content"))


_NAMED = "(SELECT k, CASE k % 2 WHEN 0 THEN 'matplotlib/matplotlib' ELSE 'pydata/xarray' END AS repo, commit, path, content FROM v_env_files)"


@query("pick_env_file", f"""SELECT repo, commit, CASE WHEN ok THEN path END AS path, CASE WHEN ok THEN 'name: testbed' || substr(content, strpos(content, chr(10))) END AS text, CASE WHEN NOT ok THEN 'no such file' END AS error
  FROM (SELECT *, path = 'environment.yml' OR (repo = 'pydata/xarray' AND path = 'ci/requirements/environment.yml') AS ok FROM {_NAMED} n) x""")
def _(spark, sf_dir):
    files = run_sql(spark, sf_dir, f"SELECT * FROM {_NAMED} n")
    instances = files.select("repo", F.col("commit").alias("environment_setup_commit"))
    return envs.pick_env_file(instances, files, envs.ENVIRONMENT_PATHS)


@query("cached_env_lookup", f"""WITH i AS (SELECT instance_id, regexp_extract(instance_id, '^(.*)-[^-]*$', 1) AS repo_key, regexp_extract(instance_id, '-([^-]*)$', 1) AS number FROM v_instances)
  SELECT i.*, CASE WHEN v.version LIKE '1.%' THEN 'env ' || v.number END AS text FROM i JOIN v_instances v USING (instance_id)""")
def _(spark, sf_dir):
    inst = load(spark, sf_dir, "v_instances")
    cache = inst.filter("version LIKE '1.%'").select(
        F.replace("repo", F.lit("/"), F.lit("__")).alias("repo_key"), F.col("number").cast("string").alias("number"),
        F.concat(F.lit("env "), "number").alias("text"))
    return envs.cached_env_lookup(inst, cache)


@query("resolve_spec", """SELECT instance_id, repo, version, CASE WHEN version NOT LIKE '%.5' THEN 'run ' || version END AS test_cmd, CASE WHEN FAIL_TO_PASS IS NULL THEN '' ELSE 't1,t2' END AS fail_to_pass,
  't3,t' || (4 + number % 3) AS pass_to_pass, CASE WHEN version LIKE '%.5' THEN 'no specification' END AS error FROM v_instances""")
def _(spark, sf_dir):
    inst = load(spark, sf_dir, "v_instances")
    spec = inst.filter("version NOT LIKE '%.5'").select("repo", "version", F.concat(F.lit("run "), "version").alias("test_cmd")).distinct()
    out = envs.resolve_spec(inst, spec)
    return out.withColumns({c: F.array_join(c, ",") for c in ("fail_to_pass", "pass_to_pass")})


@query("default_test_commands", """SELECT instance_id, pos, command FROM (SELECT instance_id, 0 AS pos, 'setup ' || version AS command FROM v_instances UNION ALL SELECT instance_id, 1, 'run ' || version FROM v_instances)""")
def _(spark, sf_dir):
    from patchloom.operators.diffs import default_test_commands

    inst = load(spark, sf_dir, "v_instances")
    spec = inst.select("repo", "version", F.array(F.concat(F.lit("setup "), "version"), F.concat(F.lit("run "), "version")).alias("test_cmd")).distinct()
    return default_test_commands(inst, spec)
