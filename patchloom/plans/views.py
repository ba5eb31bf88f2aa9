"""Input views derived from the given tables.

The given tables hold no pull requests, diffs or logs, so each view below derives
them, whole table in, whole table out, in SQL that both Spark and the checking
engine accept. Only inputs are shared this way; the operators under test are
DataFrame code on one side and separate SQL on the other.

Text values are built row by row from one source row, so no view collects an
unbounded group into one value.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# The largest table. A few of its columns look small by their part of the file, so its joins
# are told to sort; they would send all of its rows through the driver otherwise.
FACTS = "lineitem"

VIEWS: dict[str, str] = {}
TEXTS: dict[str, tuple[str, ...]] = {}
NL = "chr(10)"


def view(name: str, sql: str, texts: tuple[str, ...] = ()) -> None:
    """Add a view; ``texts`` names columns made by a long expression."""
    VIEWS[name] = " ".join(sql.split("\n"))
    TEXTS[name] = texts


def needed(sql: str) -> list[str]:
    """View names used by ``sql``, dependencies first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in out:
                visit(VIEWS[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it uses as common table expressions."""
    names = needed(sql)
    if not names:
        return sql
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.strip()
    m = re.match(r"(?is)with\s+(recursive\s+)?", body)
    if m:
        return f"WITH {m.group(1) or ''}{ctes}, {body[m.end():]}"
    return f"WITH {ctes} {body}"


def READ(spark: SparkSession, path: str) -> DataFrame:  # noqa: N802  (a runner on small files may put its own here)
    return spark.read.parquet(path)


_LOADED: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """Analyse an input once per session and folder; the plan stays lazy."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir.rstrip("/"), name)
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return _once(spark, sf_dir, name, lambda: READ(spark, path))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view (or given table) as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    return _once(
        spark, sf_dir, name, lambda: hold(_define(spark, sf_dir, VIEWS[name]), *TEXTS[name])
    )


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over given tables and views."""
    return _define(spark, sf_dir, sql)


def _define(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run ``sql`` with every table and view it names bound to a temporary view of this folder."""
    tag = f"{zlib.crc32(sf_dir.rstrip('/').encode()):08x}"

    def bind(m: re.Match) -> str:
        name = m.group(0)
        if name not in VIEWS and name not in TABLES:
            return name
        bound = f"{name}_{tag}"
        df = load(spark, sf_dir, name)
        (df.hint("merge") if name == FACTS else df).createOrReplaceTempView(bound)
        return bound

    names = "|".join(TABLES)
    return spark.sql(re.sub(rf"\bv_\w+|(?i:(?<=\bfrom )|(?<=\bjoin ))(?:{names})\b", bind, sql))


def hold(df: DataFrame, *texts: str) -> DataFrame:
    """Keep Spark from copying the long expression behind a column into every use of it.

    A stored column would not need this; explode of a one-item array gives the same
    effect without a shuffle.
    """
    order = df.columns
    for t in texts:
        df = df.select(*[c for c in order if c != t], F.explode(F.array(t)).alias(t)).select(*order)
    return df


def iso(date_expr: str) -> str:
    return f"(CAST(CAST({date_expr} AS DATE) AS STRING) || 'T00:00:00Z')"


def text_lines(*parts: str) -> str:
    """SQL expression that joins line expressions with a newline after each."""
    return "(" + " || ".join(f"{p} || {NL}" for p in parts) + ")"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- repositories -----------------------------------------------------------------

# A few well-known repositories take part because some rules depend on them.
NAMED_REPOS = {
    0: "django/django",
    1: "chartjs/Chart.js",
    2: "sympy/sympy",
    3: "pvlib/pvlib-python",
    4: "pallets/flask",
    5: "pyvista/pyvista",
    6: "google/gson",
    7: "markedjs/marked",
}

view(
    "v_repo",
    "SELECT n_nationkey, CASE n_nationkey "
    + " ".join(f"WHEN {k} THEN {q(v)}" for k, v in NAMED_REPOS.items())
    + " ELSE 'org_' || CAST(n_nationkey AS STRING) || '/proj_' || CAST(n_nationkey AS STRING) END AS repo FROM nation",
)

# order row with its repository: the base of pull requests, instances and diffs
view(
    "v_work",
    """SELECT o.o_orderkey AS k, r.repo AS repo, c.c_nationkey AS nk, o.o_orderstatus AS st,
       o.o_orderpriority AS model, o.o_orderdate AS odate, o.o_totalprice AS price, c.c_custkey AS ck,
       replace(r.repo, '/', '__') || '-' || CAST(o.o_orderkey AS STRING) AS instance_id
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN v_repo r ON c.c_nationkey = r.n_nationkey""",
)

# --- diffs ------------------------------------------------------------------------


def _diff_sql() -> str:
    path = (
        "CASE k % 4 WHEN 0 THEN 'src/pkg_' || CAST(k % 7 AS STRING) || '/mod.py' "
        "WHEN 1 THEN 'tests/unit/test_' || CAST(k % 9 AS STRING) || '.py' "
        "WHEN 2 THEN 'lib/latest.py' "
        "ELSE CASE k % 3 WHEN 0 THEN 'client/data/app' || CAST(k % 5 AS STRING) || '.js' "
        "WHEN 1 THEN 'client/x/__snapshots__/y' || CAST(k % 5 AS STRING) || '.js.snap' "
        "ELSE 'test/e2e/spec-' || CAST(k % 5 AS STRING) || '.js' END END"
    )
    first = text_lines(
        "'diff --git a/' || p || ' b/' || p",
        "'index 1111111..2222222 100644'",
        "'--- a/' || p",
        "'+++ b/' || p",
        "'@@ -' || CAST(10 + k % 30 AS STRING) || ',6 +' || CAST(10 + k % 30 AS STRING) || ',7 @@ def fn():'",
        "' ctx one'",
        "' ctx two  '",
        "'-old ' || CAST(k AS STRING)",
        "'+new ' || CAST(k AS STRING) || '  '",
        "'+    pytest.raises(match=1)'",
        "' ctx three'",
        "' '",
        "' ctx five'",
    )
    second = text_lines(
        "'@@ -60,4 +61,3 @@'",
        "' a'",
        "'--- dashes'",
        "' b'",
        "' c'",
    )
    added = text_lines(
        "'diff --git a/docs/n' || CAST(k % 6 AS STRING) || '.md b/docs/n' || CAST(k % 6 AS STRING) || '.md'",
        "'new file mode 100644'",
        "'index 0000000..3333333'",
        "'--- /dev/null'",
        "'+++ b/docs/n' || CAST(k % 6 AS STRING) || '.md'",
        "'@@ -0,0 +1,2 @@'",
        "'+first'",
        "'+second ' || CAST(k % 3 AS STRING)",
    )
    deleted = text_lines(
        "'diff --git a/old/gone.py b/old/gone.py'",
        "'deleted file mode 100644'",
        "'index 4444444..0000000'",
        "'--- a/old/gone.py'",
        "'+++ /dev/null'",
        "'@@ -1,2 +0,0 @@'",
        "'-x = 1'",
        "'-y = 2'",
    )
    renamed = text_lines(
        "'diff --git a/pkg/was.py b/pkg/is.py'",
        "'similarity index 100%'",
        "'rename from pkg/was.py'",
        "'rename to pkg/is.py'",
    )
    short = text_lines(
        "'diff --git a/VERSION b/VERSION'",
        "'index 5555555..6666666 100644'",
        "'--- a/VERSION'",
        "'+++ b/VERSION'",
        "'@@ -1 +1 @@'",
        "'-1.' || CAST(k % 4 AS STRING)",
        "'+1.' || CAST(k % 4 + 1 AS STRING)",
    )
    body = (
        f"{first} || CASE WHEN k % 2 = 0 THEN {second} ELSE '' END || "
        f"CASE k % 5 WHEN 0 THEN {added} WHEN 1 THEN {deleted} WHEN 2 THEN {renamed} ELSE '' END || "
        f"CASE WHEN k % 7 = 0 THEN {short} ELSE '' END"
    )
    return (
        "SELECT k AS id, repo, instance_id, CASE WHEN k % 31 = 0 THEN NULL WHEN k % 37 = 0 THEN '' "
        f"ELSE {body} END AS patch FROM (SELECT k, repo, instance_id, {path} AS p FROM v_work) w"
    )


view("v_diffs", _diff_sql(), texts=("patch",))

# --- pull requests, commits, issues, comments -------------------------------------

_A = "CAST(nk + 25 * (k % 3) AS STRING)"
_B = "CAST(nk + 25 * (k % 2) + 25 AS STRING)"
view(
    "v_pulls",
    f"""SELECT w.repo, w.k AS number,
       CASE k % 6 WHEN 0 THEN 'Fixes #' || {_A} WHEN 1 THEN 'Update' WHEN 2 THEN CAST(NULL AS STRING)
         WHEN 3 THEN 'fix  #' || {_A} || ' <!-- open' WHEN 4 THEN 'Tidy' ELSE 'Close #' || {_A} END AS title,
       CASE k % 6 WHEN 0 THEN CAST(NULL AS STRING)
         WHEN 1 THEN 'closes #' || {_A} || ' and Resolves' || {NL} || '#' || {_B} || ' <!-- fixes #999 -->'
         WHEN 2 THEN 'see #5' WHEN 3 THEN 'x --> resolved #' || {_B}
         WHEN 4 THEN 'Prefix #3 fixing #4 éfixes #7' ELSE 'closed #' || {_A} END AS body,
       {iso('odate')} AS created_at,
       CASE WHEN st = 'P' THEN CAST(NULL AS STRING) ELSE {iso('odate')} END AS merged_at,
       'c' || CAST(k AS STRING) AS base_commit, d.patch AS diff
       FROM v_work w JOIN v_diffs d ON w.k = d.id""",
    texts=("title", "body", "diff"),
)
view(
    "v_commits",
    f"""SELECT w.repo, l.l_orderkey AS number,
       CAST(l.l_linenumber AS BIGINT) * 1000000000000 + l.l_partkey * 1000000 + l.l_suppkey * 100
         + CAST(l.l_quantity AS BIGINT) AS seq,
       CASE l.l_linenumber % 4 WHEN 0 THEN 'fixes #' || CAST(w.nk AS STRING) WHEN 1 THEN 'work'
         WHEN 2 THEN 'Resolve #' || CAST(w.nk + 25 AS STRING) || ' <!-- later -->' ELSE 'see #1' END AS message,
       {iso('l.l_shipdate')} AS author_date
       FROM lineitem l JOIN v_work w ON l.l_orderkey = w.k""",
)
view(
    "v_issues",
    """SELECT r.repo, c.conv_id AS number,
       CASE WHEN c.conv_id % 5 = 0 THEN CAST(NULL AS STRING) ELSE 'Issue ' || CAST(c.conv_id AS STRING) END AS title,
       CASE WHEN c.conv_id % 10 = 0 THEN CAST(NULL AS STRING) ELSE c.text END AS body
       FROM conversations c JOIN v_repo r ON c.conv_id % 25 = r.n_nationkey WHERE c.turn = 0""",
)
view(
    "v_comments",
    """SELECT r.repo, c.conv_id AS issue, c.turn AS seq, c.text AS body,
       CAST(CAST(1994 + (c.conv_id + c.turn * 3) % 8 AS BIGINT) AS STRING) || '-06-15T00:00:00Z' AS updated_at
       FROM conversations c JOIN v_repo r ON c.conv_id % 25 = r.n_nationkey WHERE c.turn > 0""",
)

# --- task instances ---------------------------------------------------------------

view(
    "v_text",
    f"""SELECT doc_id, lang, source,
       CASE doc_id % 12 WHEN 0 THEN text || ' fixes #' || CAST(doc_id % 50 AS STRING)
         WHEN 1 THEN text || ' see https://example.org/x'
         WHEN 2 THEN text || {NL} || 'shot at pic.PNG here'
         WHEN 3 THEN text || ' at 0123456789abcdef0123456789abcdef01234567'
         WHEN 4 THEN 'few words only #' || CAST(doc_id AS STRING)
         WHEN 5 THEN text || ' /0123456789abcdef0123456789abcdef01234567 end'
         WHEN 6 THEN text || ' [0123456789abcdef0123456]'
         WHEN 7 THEN text || ' #' || CAST(doc_id % 90 AS STRING)
         WHEN 8 THEN text || ' clip.webm.' WHEN 9 THEN text || ' www.site' ELSE text END AS text
       FROM documents""",
    texts=("text",),
)
view(
    "v_instances",
    f"""SELECT w.repo, w.instance_id, w.k AS number, 'c' || CAST(w.k % 40 AS STRING) AS base_commit, d.patch AS patch,
       CASE WHEN w.k % 3 = 0 THEN d.patch WHEN w.k % 3 = 1 THEN '' ELSE replace(d.patch, 'pytest.raises(match=1)', 'ok()') END AS test_patch,
       'Statement ' || CAST(w.k AS STRING) AS problem_statement, '' AS hints_text,
       {iso('w.odate')} AS created_at,
       CAST(1 + w.k % 4 AS STRING) || '.' || CAST(w.k % 11 AS STRING) AS version,
       CASE WHEN w.k % 29 = 0 THEN CAST(NULL AS STRING) ELSE '["t1", "t2"]' END AS FAIL_TO_PASS,
       '["t3", "t' || CAST(4 + w.k % 3 AS STRING) || '"]' AS PASS_TO_PASS,
       CASE WHEN w.k % 4 = 0 THEN CAST(NULL AS STRING) ELSE 'e' || CAST(w.k % 8 AS STRING) END AS environment_setup_commit
       FROM v_work w JOIN v_diffs d ON w.k = d.id""",
    texts=("patch", "test_patch"),
)

# --- predictions, gold lists, status rows, logs -----------------------------------

_SEQ = (
    "CAST(l.l_linenumber AS BIGINT) * 1000000000000 + l.l_partkey * 1000000 + l.l_suppkey * 100 "
    "+ CAST(l.l_quantity AS BIGINT)"
)
view(
    "v_predictions",
    f"""SELECT {_SEQ} AS seq,
       CASE WHEN l.l_quantity = 50 THEN 'unknown-' || CAST(l.l_orderkey AS STRING) ELSE w.instance_id END AS instance_id,
       w.model AS model_name_or_path,
       CASE l.l_linenumber % 7 WHEN 3 THEN CAST(NULL AS STRING) WHEN 5 THEN '' ELSE 'patch ' || CAST(l.l_partkey AS STRING) END AS model_patch,
       'out ' || CAST(l.l_suppkey AS STRING) AS full_output
       FROM lineitem l JOIN v_work w ON l.l_orderkey = w.k""",
)
view(
    "v_gold",
    """SELECT DISTINCT w.instance_id, w.repo,
       CASE l.l_linenumber % 4 WHEN 1 THEN 'FAIL_TO_PASS' WHEN 2 THEN 'PASS_TO_PASS' WHEN 3 THEN 'FAIL_TO_FAIL'
         ELSE 'PASS_TO_FAIL' END AS category,
       't' || CAST(l.l_linenumber AS STRING) AS test
       FROM lineitem l JOIN v_work w ON l.l_orderkey = w.k""",
)
view(
    "v_status",
    f"""SELECT w.model, w.instance_id, w.repo, 't' || CAST(l.l_linenumber AS STRING) AS test, {_SEQ} AS seq,
       CASE WHEN l.l_linestatus = 'O' THEN 'PASSED' ELSE 'FAILED' END AS before,
       CASE WHEN l.l_returnflag = 'A' THEN 'PASSED' WHEN l.l_returnflag = 'N' AND l.l_quantity < 10 THEN 'SKIPPED'
         WHEN l.l_returnflag = 'N' THEN 'XFAIL' WHEN l.l_quantity < 20 THEN 'ERROR' WHEN l.l_quantity < 30 THEN 'PASSED' ELSE 'FAILED' END AS status
       FROM lineitem l JOIN v_work w ON l.l_orderkey = w.k""",
)


def _run_log_sql() -> str:
    def test_line(i: int) -> str:
        return (
            f"CASE WHEN k % 3 = 0 THEN 'PASSED t{i}' WHEN (k + {i}) % 9 = 0 THEN 'FAILED t{i} - boom' "
            f"WHEN (k + {i}) % 11 = 0 THEN 'SKIPPED t{i}' WHEN (k + {i}) % 13 = 0 THEN 'ERROR t{i}' "
            f"WHEN (k + {i}) % 7 = 0 THEN 'noise {i}' WHEN (k + {i}) % 17 = 0 THEN 'XFAIL t{i}' ELSE 'PASSED t{i}' END"
        )

    tests = text_lines(*[test_line(i) for i in range(1, 8)])
    return (
        "SELECT instance_id, model, repo, 'setup' || chr(10) || CASE WHEN k % 23 = 0 THEN '>>>>> Tests Timed Out' || chr(10) ELSE '' END "
        "|| CASE WHEN k % 19 = 0 THEN '' ELSE '>>>>> Start Test Output' || chr(10) END "
        f"|| CASE WHEN k % 13 = 0 THEN 'nothing' || chr(10) ELSE {tests} END "
        "|| CASE WHEN k % 29 = 0 THEN '' ELSE '>>>>> End Test Output' || chr(10) END "
        f"|| CASE WHEN k % 13 = 0 THEN {tests} ELSE 'bye' END AS log FROM v_work"
    )


view("v_logs", _run_log_sql(), texts=("log",))

# --- repository snapshots and release calendars ------------------------------------

_VERSION_FILE = (
    "CASE s.nk % 8 WHEN 0 THEN 'django/__init__.py' WHEN 2 THEN 'sympy/__init__.py' WHEN 4 THEN 'flask/__init__.py' "
    "WHEN 5 THEN 'pyvista/_version.py' ELSE 'sklearn/__init__.py' END"
)
_VERSION_TEXT = (
    f"CASE s.c % 6 WHEN 0 THEN '__version__ = \"1.' || CAST(s.c AS STRING) || '.3rc1\"' "
    f"WHEN 1 THEN 'VERSION = (3, ' || CAST(s.c AS STRING) || ', 0)' "
    f"WHEN 2 THEN '\"\"\"' || {NL} || '__version__ = ''9.9''' || {NL} || '\"\"\"' || {NL} || '__version__ = ''4.' || CAST(s.c AS STRING) || '''' "
    f"WHEN 3 THEN 'version_info = 0, ' || CAST(s.c AS STRING) || ', 1' WHEN 4 THEN 'nothing' "
    f"ELSE '__version__ = ''2.' || CAST(s.c AS STRING) || '''' || {NL} || 'VERSION = (5, 6)' END"
)
view(
    "v_files",
    f"""SELECT s.repo, 'c' || CAST(s.c AS STRING) AS commit,
       CASE f.nr WHEN 0 THEN {_VERSION_FILE} WHEN 1 THEN 'sympy/release.py' WHEN 2 THEN 'README.md' WHEN 3 THEN 'readme' WHEN 4 THEN 'src/pkg_' || CAST(s.c % 7 AS STRING) || '/mod.py'
         WHEN 5 THEN 'lib/latest.py' WHEN 6 THEN 'tests/unit/test_' || CAST(s.c % 9 AS STRING) || '.py' WHEN 7 THEN 'old/gone.py' WHEN 8 THEN 'docs/readme.txt' ELSE 'VERSION' END AS path,
       CASE f.nr WHEN 0 THEN {_VERSION_TEXT} WHEN 1 THEN CASE WHEN s.c % 2 = 0 THEN '__version__ = "7.' || CAST(s.c AS STRING) || '.1"' ELSE 'none' END
         WHEN 2 THEN '# Read me' || {NL} || 'repo ' || s.repo WHEN 3 THEN 'short' || {NL}
         WHEN 4 THEN repeat('line of code ' || CAST(s.c AS STRING) || {NL}, CAST(30 + s.c AS INT)) WHEN 5 THEN 'import os' || {NL} || {NL} || repeat('value = ' || CAST(s.c AS STRING) || {NL}, 70) || 'é = 1'
         ELSE 'x = 1' || {NL} || 'y = ' || CAST(s.c AS STRING) || {NL} END AS content
       FROM (SELECT DISTINCT repo, nk, k % 40 AS c, 1 AS one FROM v_work) s
       JOIN (VALUES (0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1), (8, 1), (9, 1)) f(nr, one) ON s.one = f.one""",
    texts=("path", "content"),
)
view(
    "v_releases",
    """SELECT repo, month || '-15' AS date, CAST(CAST(substr(month, 1, 4) AS INT) - 1990 AS STRING) || '.' || CAST(CAST(substr(month, 6, 2) AS INT) AS STRING) AS version
       FROM (SELECT repo, month, min(month) OVER (PARTITION BY repo) AS first_month
         FROM (SELECT DISTINCT repo, substr(CAST(CAST(odate AS DATE) AS STRING), 1, 7) AS month FROM v_work) w) m
       WHERE month > first_month""",
)
_MONTHS = "january february march april may june july august september october november december".split()
_MONTH = "CASE page_id % 12 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MONTHS)) + " END"
view(
    "v_release_pages",
    f"""SELECT r.repo, p.page_id,
       '<a class="reference internal nav-link active" href="#v0-' || CAST(page_id % 20 AS STRING) || '-1-' || {_MONTH} || '-' || CAST(1 + page_id % 28 AS STRING) || '-' || CAST(2015 + page_id % 8 AS STRING) || '">v0.1 (x)</a>' || {NL} ||
       '<a class="reference internal nav-link" href="#v2-' || CAST(page_id % 9 AS STRING) || '-0-' || CAST(1 + page_id % 28 AS STRING) || '-' || {_MONTH} || '-2021">v2 (y)</a>' || {NL} ||
       '<a class="reference internal nav-link" href="#version-x">Version ' || CAST(page_id % 6 AS STRING) || '.' || CAST(page_id % 13 AS STRING) || '.2 (20' || CAST(10 + page_id % 12 AS STRING) || '-0' || CAST(1 + page_id % 9 AS STRING) || '-11)</a>' || {NL} ||
       '<a class="reference internal" href="prev_whats_new/whats_new_3.' || CAST(page_id % 14 AS STRING) || '.0.html">What''s new in Matplotlib 3.x (' || upper(substr({_MONTH}, 1, 1)) || substr({_MONTH}, 2, 2) || ' ' || CAST(1 + page_id % 28 AS STRING) || ', 2020)</a>' || {NL} || html AS html,
       CASE page_id % 4 WHEN 0 THEN '[0.' || CAST(page_id % 10 AS STRING) || '.2] - 2021-10-' || CAST(10 + page_id % 20 AS STRING)
         WHEN 1 THEN 'SQLFluff 1.' || CAST(page_id % 10 AS STRING) || '.0 out' WHEN 2 THEN 'Bugfix Release [2.' || CAST(page_id % 5 AS STRING) || '.1] - 2022-01-' || CAST(10 + page_id % 20 AS STRING)
         ELSE 'news' END AS name, '2020-0' || CAST(1 + page_id % 9 AS STRING) || '-01T00:00:00Z' AS published_at
       FROM pages p JOIN v_repo r ON p.page_id % 25 = r.n_nationkey""",
    texts=("html", "name"),
)
_TAB = '<a class="vertical-tabs__tab--with-icon" href='
view(
    "v_packages",
    f"""SELECT page_id, url, html || CASE page_id % 5
       WHEN 0 THEN '{_TAB}"https://x.org">Homepage</a>{_TAB}"https://github.com/own' || CAST(page_id AS STRING) || '/proj">Source Code</a>'
       WHEN 1 THEN '{_TAB}"https://GitHub.com/o/p">Docs</a>' WHEN 2 THEN '{_TAB}"https://GitHub.com/a/b"> <i></i> homepage </a>' ELSE '' END AS html,
       CASE page_id % 3 WHEN 0 THEN 'see https://github.com/o' || CAST(page_id AS STRING) || '/r.x/issues/' || CAST(page_id * 7 AS STRING) || '#c' WHEN 1 THEN url ELSE 'github.com/a/issues/1' END AS link
       FROM pages""",
    texts=("html", "link"),
)

# --- retrieval, hits, responses ----------------------------------------------------

view("v_corpus", "SELECT source AS corpus, CAST(doc_id AS STRING) AS docid, text AS contents FROM documents")
view("v_queries", "SELECT item_id AS query_id, 'src' || CAST(item_id % 20 AS STRING) AS corpus, text AS query FROM benchmark")
view(
    "v_hits",
    """SELECT DISTINCT w.instance_id, CAST(l.l_linenumber AS INT) AS rank,
       CASE l.l_linenumber WHEN 1 THEN 'lib/latest.py' WHEN 2 THEN 'old/gone.py' WHEN 3 THEN 'VERSION' WHEN 4 THEN 'docs/readme.txt'
         WHEN 5 THEN 'README.md' WHEN 6 THEN 'missing.py' ELSE 'readme' END AS docid
       FROM lineitem l JOIN v_work w ON l.l_orderkey = w.k""",
)
_FENCE = "chr(96) || chr(96) || chr(96)"
view(
    "v_responses",
    f"""SELECT conv_id, turn, role, CASE (conv_id + turn) % 8
       WHEN 0 THEN 'x <patch>' || text || '</patch> <diff>late</diff>'
       WHEN 1 THEN 'see ' || {_FENCE} || 'diff' || {NL} || text || {_FENCE} || ' and <code>c</code>'
       WHEN 2 THEN '<note>n</note> ' || {_FENCE} || {NL} || text || {_FENCE}
       WHEN 3 THEN text || '</s> tail' WHEN 4 THEN CAST(NULL AS STRING)
       WHEN 5 THEN '<a>' || text || '</b>' WHEN 6 THEN text || repeat('ab', 80) || 'end of it all, well'
       ELSE substr(text, 1, 70) || repeat('-=', 40) || text END AS text
       FROM conversations""",
    texts=("text",),
)
