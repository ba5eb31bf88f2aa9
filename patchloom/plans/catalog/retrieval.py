"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.functions import stem
from patchloom.operators import retrieve
from patchloom.plans.registry import query
from patchloom.plans.views import load, run_sql

def _scores(terms) -> str:
    """SQL of all scores; ``terms`` turns a text column into its list of terms."""
    return f"""
dt AS MATERIALIZED (SELECT corpus, docid, {terms('contents')} AS w FROM v_corpus),
st AS (SELECT corpus, count(*) AS n_docs, avg(len(w)) AS avg_dl FROM dt GROUP BY 1),
po AS (SELECT corpus, docid, len(w) AS dl, term, count(*) AS tf FROM (SELECT corpus, docid, w, unnest(w) AS term FROM dt) x GROUP BY ALL),
dfr AS (SELECT corpus, term, count(*) AS df FROM po GROUP BY 1, 2),
qt AS (SELECT query_id, corpus, term, count(*) AS qtf FROM (SELECT query_id, corpus, unnest({terms('query')}) AS term FROM v_queries) x GROUP BY ALL),
sc AS (SELECT query_id, docid, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / avg_dl))), 10) AS exact
  FROM qt JOIN po USING (corpus, term) JOIN dfr USING (corpus, term) JOIN st USING (corpus) GROUP BY 1, 2),
hit AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, docid)::INTEGER AS rank, docid, round(exact, 6) AS score FROM sc QUALIFY rank <= 20)"""


def _words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+')"


def _english(text: str) -> str:
    stops = ", ".join(f"'{w}'" for w in stem.STOP_WORDS)
    whole = f"list_filter({_words(text)}, lambda w: w NOT IN ({stops}))"
    steps = f"list_transform({whole}, lambda w: CASE WHEN length(w) < 3 THEN '#' || w ELSE w END)"  # short words stay as they are
    for rules in stem.STEPS:
        cases = " ".join(f"WHEN regexp_matches(w, '{r.test}') THEN regexp_replace(w, '{r.pattern}', '\\1{r.ending}')" for r in rules)
        steps = f"list_transform({steps}, lambda w: CASE WHEN starts_with(w, '#') THEN w {cases} ELSE w END)"
    return f"list_transform({steps}, lambda w: ltrim(w, '#'))"


_SCORES, _ENGLISH_SCORES = _scores(_words), _scores(_english)
# gold: good documents of the query's corpus
_GOLD = "gold AS (SELECT q.query_id, CAST(d.doc_id AS VARCHAR) AS docid FROM v_queries q JOIN documents d ON d.source = q.corpus JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1)"


_RECALL = f"""{_GOLD}, r AS (SELECT g.query_id, count(h.docid) / count(*) AS recall FROM gold g LEFT JOIN hit h ON h.query_id = g.query_id AND h.docid = g.docid GROUP BY 1)
  SELECT round(avg(recall) * 100, 6) AS avg_recall, round(avg((recall = 1)::INT) * 100, 6) AS all_recall, round(avg((recall > 0)::INT) * 100, 6) AS any_recall FROM r"""


def _hits(spark, sf_dir, **options):
    return retrieve.bm25_topk(load(spark, sf_dir, "v_queries"), load(spark, sf_dir, "v_corpus"), **options)


def _recall(spark, sf_dir, **options):
    gold = run_sql(spark, sf_dir, """SELECT q.query_id, CAST(d.doc_id AS STRING) AS docid FROM v_queries q JOIN documents d ON d.source = q.corpus
      JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1""")
    return retrieve.recall_summary(retrieve.recall_of(_hits(spark, sf_dir, **options), gold, "query_id"))


@query("bm25_topk", f"WITH {_SCORES} SELECT * FROM hit")
def _(spark, sf_dir):
    return _hits(spark, sf_dir)


@query("bm25_english", f"WITH {_ENGLISH_SCORES} SELECT * FROM hit")
def _(spark, sf_dir):
    return _hits(spark, sf_dir, analyser=stem.english)


@query("retrieval_recall", f"WITH {_SCORES}, {_RECALL}")
def _(spark, sf_dir):
    return _recall(spark, sf_dir)


@query("retrieval_recall_english", f"WITH {_ENGLISH_SCORES}, {_RECALL}")
def _(spark, sf_dir):
    return _recall(spark, sf_dir, analyser=stem.english)


_SHOWN = """(SELECT instance_id, patch, '[start of ' || CASE number % 3 WHEN 0 THEN 'README.md' ELSE 'lib/latest.py' END || ']' || chr(10) || 'x' || chr(10) || '[end of '
  || CASE number % 3 WHEN 0 THEN 'README.md' ELSE 'lib/latest.py' END || ']' || chr(10) || '[start of src/pkg_' || CAST(number % 7 AS STRING) || '/mod.py]' || chr(10) || 'a' || chr(10) || 'b' || chr(10)
  || '[end of src/pkg_' || CAST(number % CASE number % 5 WHEN 0 THEN 6 ELSE 7 END AS STRING) || '/mod.py]' || chr(10) AS text, number FROM v_instances)"""


@query("retrieval_recall_text", f"""WITH s AS {_SHOWN}, b AS (SELECT instance_id, CASE WHEN number % 3 = 0 THEN [] ELSE ['lib/latest.py'] END ||
    CASE WHEN number % 5 = 0 AND number % 6 <> number % 7 THEN [] ELSE ['src/pkg_' || number % 7 || '/mod.py'] END AS shown,
    list_distinct(regexp_extract_all(coalesce(patch, ''), '--- a/(.+)', 1)) AS gold FROM s)
  SELECT instance_id, len(gold)::INTEGER AS n_gold, len(list_intersect(shown, gold)) / len(gold) AS recall FROM b WHERE len(gold) > 0""")
def _(spark, sf_dir):
    return retrieve.recall_from_text(run_sql(spark, sf_dir, f"SELECT * FROM {_SHOWN} s"))


@query("missing_ids", "SELECT i.instance_id, i.repo FROM v_instances i WHERE NOT EXISTS (SELECT 1 FROM v_hits h WHERE h.instance_id = i.instance_id)")
def _(spark, sf_dir):
    return retrieve.remaining(load(spark, sf_dir, "v_instances").select("instance_id", "repo"), load(spark, sf_dir, "v_hits"))


@query("attach_hits", """SELECT i.instance_id, coalesce(string_agg(h.docid, ',' ORDER BY h.rank), '') AS hits FROM v_instances i
  LEFT JOIN v_hits h ON h.instance_id = i.instance_id AND h.rank <= 3 GROUP BY 1""")
def _(spark, sf_dir):
    out = retrieve.attach_hits(load(spark, sf_dir, "v_instances").select("instance_id"), load(spark, sf_dir, "v_hits"), 3)
    return out.select("instance_id", F.array_join("hits", ",").alias("hits"))


_EDGES = "(SELECT repo, k AS src, CAST(FLOOR(k / 8) AS BIGINT) AS dst FROM v_work UNION ALL SELECT repo, k AS src, CAST(FLOOR(k / 9) AS BIGINT) AS dst FROM v_work)"


@query("import_closure", f"""WITH RECURSIVE e AS {_EDGES}, r AS (SELECT repo, k AS seed, k AS node FROM v_work UNION SELECT r.repo, r.seed, e.dst FROM r JOIN e ON e.repo = r.repo AND e.src = r.node)
  SELECT repo, seed, node FROM r""")
def _(spark, sf_dir):
    edges = run_sql(spark, sf_dir, f"SELECT * FROM {_EDGES} e")
    seeds = load(spark, sf_dir, "v_work").select("repo", F.col("k").alias("seed"))
    return retrieve.import_closure(edges, seeds, ["repo"])


_IMPORTS = """(SELECT repo, commit, path, CASE WHEN path LIKE 'src/%' THEN 'import lib' || chr(10) || 'import tests.unit, json' WHEN path = 'lib/latest.py' THEN 'from old import gone'
  WHEN path LIKE 'tests/%' THEN 'from ..lib import latest' || chr(10) || 'from . import q' WHEN path LIKE 'old/%' THEN 'import (' ELSE content END AS content FROM v_files)"""


@query("import_edges")
def _(spark, sf_dir):
    return retrieve.import_edges(run_sql(spark, sf_dir, f"SELECT * FROM {_IMPORTS} f"))


@query("readme_files", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY repo, commit ORDER BY length(path), path) AS rn FROM v_files WHERE regexp_matches(path, '(?i)^readme[^/]*$'))
  SELECT repo, commit, path, rn = 1 AS shortest FROM r""")
def _(spark, sf_dir):
    files = load(spark, sf_dir, "v_files")
    one = retrieve.readme_files(files, shortest_only=True).select("repo", "commit", F.col("path").alias("best"))
    return retrieve.readme_files(files).join(one, ["repo", "commit"]).select(
        "repo", "commit", "path", (F.col("path") == F.col("best")).alias("shortest"))


@query("docs_contents", "SELECT repo, commit, path, path || chr(10) || content AS contents FROM v_files")
def _(spark, sf_dir):
    return retrieve.with_contents(load(spark, sf_dir, "v_files")).drop("content")


_PYTHON = """(SELECT repo, commit, path, CASE WHEN path LIKE 'src/%' THEN '"mod ' || commit || '"' || chr(10) || 'x = 1' || chr(10) || 'class A:' || chr(10) || '    "doc a"' || chr(10) || '    def f(self):' || chr(10) || '        "doc f"' || chr(10)
  ELSE content END AS content FROM v_files)"""


@query("docs_docstrings")
def _(spark, sf_dir):
    return retrieve.with_docstrings(run_sql(spark, sf_dir, f"SELECT * FROM {_PYTHON} f"))


@query("docs_signatures")
def _(spark, sf_dir):
    return retrieve.with_signatures(run_sql(spark, sf_dir, f"SELECT * FROM {_PYTHON} f"))


@query("repo_files", "SELECT repo, commit, path, content FROM v_files WHERE path LIKE '%.py' AND len(list_intersect(regexp_split_to_array(lower(path), '[ _/.]'), ['test', 'tests', 'testing'])) = 0")
def _(spark, sf_dir):
    from patchloom.sources.readers import repo_texts

    raw = load(spark, sf_dir, "v_files").withColumn("content", F.col("content").cast("binary"))
    return repo_texts(raw)
