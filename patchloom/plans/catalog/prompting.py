"""Prompt and token queries. Long texts are compared by their md5."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.functions import tokens as tk
from patchloom.operators import diffs, prompt_texts as P, prompts, retrieve
from patchloom.plans import sqltext as st
from patchloom.plans.catalog.diffs import _FILES
from patchloom.plans.registry import query
from patchloom.plans.views import load, q, view

KEYS = ["instance_id"]

# --- SQL side ------------------------------------------------------------------------

_NUM = "(SELECT string_agg(u.nr || ' ' || u.line, chr(10) ORDER BY u.nr) FROM unnest(string_split({c}, chr(10))) WITH ORDINALITY AS u(line, nr))"
# every file of a snapshot once, with numbered and plain block
_BLOCKS = f"""
nl AS (SELECT repo, commit, path, content, u.nr, u.line FROM (SELECT *, string_split(content, chr(10)) AS ls FROM v_files) f, unnest(f.ls) WITH ORDINALITY AS u(line, nr)),
nf AS (SELECT repo, commit, path, any_value(content) AS content, string_agg(nr || ' ' || line, chr(10) ORDER BY nr) AS numbered FROM nl GROUP BY 1, 2, 3),
blk AS (SELECT *, '[start of ' || path || ']' || chr(10) || numbered || chr(10) || '[end of ' || path || ']' || chr(10) AS bn,
  '[start of ' || path || ']' || chr(10) || content || chr(10) || '[end of ' || path || ']' || chr(10) AS bp FROM nf),
ofi AS (SELECT DISTINCT i.instance_id, i.repo, i.base_commit AS commit, regexp_replace(f.source, '^.*?a/', '') AS path FROM files f JOIN v_instances i ON i.number = f.id),
rdm AS (SELECT repo, commit, trim(string_agg(bn, '' ORDER BY path), chr(10)) AS rn, trim(string_agg(bp, '' ORDER BY path), chr(10)) AS rp FROM blk WHERE regexp_matches(path, '(?i)^readme[^/]*$') GROUP BY 1, 2)"""
_CODE = f"""{_FILES}, {_BLOCKS},
code AS (SELECT o.instance_id, trim(string_agg(bn, '' ORDER BY path), chr(10)) AS cn, trim(string_agg(bp, '' ORDER BY path), chr(10)) AS cp FROM ofi o JOIN blk USING (repo, commit, path) GROUP BY 1)"""


def _join(parts: list[str]) -> str:
    return " || chr(10) || ".join(parts)


def _lit(text: str) -> str:
    return "(" + " || chr(10) || ".join(q(line) for line in text.split("\n")) + ")"


def _prompt_sql(code: str, readme: str, gap: bool, tail: list[str], ctes: str = _CODE, table: str = "code") -> str:
    head = [_lit(P.PREMISE), "'<issue>'", "i.problem_statement", "'</issue>'"] + (["''"] if gap else [])
    body = ["'<code>'", f"coalesce(r.{readme}, '')", f"coalesce(c.{code}, '')", "'</code>'"] + (["''"] if gap else [])
    return f"""WITH {ctes} SELECT i.instance_id, md5({_join(head + body + tail)}) AS digest FROM v_instances i
      LEFT JOIN rdm r ON r.repo = i.repo AND r.commit = i.base_commit LEFT JOIN {table} c ON c.instance_id = i.instance_id"""


# --- Spark side ------------------------------------------------------------------------


def _instances(spark, sf_dir):
    return load(spark, sf_dir, "v_instances")


def _oracle(spark, sf_dir):
    inst = _instances(spark, sf_dir)
    lines = diffs.diff_lines(inst.select("instance_id", "patch"), "instance_id")
    return lines, diffs.oracle_files(diffs.diff_files(lines, "instance_id"), "instance_id")


def _oracle_files(spark, sf_dir, files=None):
    files = load(spark, sf_dir, "v_files") if files is None else files
    return prompts.context_files("oracle", _instances(spark, sf_dir), files, oracle=_oracle(spark, sf_dir)[1])


def _readmes(spark, sf_dir, numbered=True):
    files = retrieve.readme_files(load(spark, sf_dir, "v_files"))
    texts = prompts.code_text(files, ["repo", "commit"], numbered)  # once per snapshot
    return _instances(spark, sf_dir).select("instance_id", "repo", F.col("base_commit").alias("commit")).join(texts, ["repo", "commit"])


def _prompt(spark, sf_dir, style, numbered=True):
    blocks = prompts.with_blocks(load(spark, sf_dir, "v_files"), numbered)
    code = prompts.code_text(_oracle_files(spark, sf_dir, blocks), KEYS)
    return prompts.prompts(_instances(spark, sf_dir), _readmes(spark, sf_dir, numbered), code, style, KEYS)


def _digest(df):
    return df.select("instance_id", F.md5("text_inputs").alias("digest"))


@query("number_lines", f"WITH {_FILES}, {_BLOCKS} SELECT repo, commit, path, numbered FROM nf")
def _(spark, sf_dir):
    return load(spark, sf_dir, "v_files").select("repo", "commit", "path", prompts.number_lines(F.col("content")).alias("numbered"))


@query("code_text", f"WITH {_CODE} SELECT instance_id, md5(cn) AS digest FROM code")
def _(spark, sf_dir):
    files = prompts.with_blocks(load(spark, sf_dir, "v_files"))
    return prompts.code_text(_oracle_files(spark, sf_dir, files), KEYS).select("instance_id", F.md5("code_text").alias("digest"))


_EDITS = f"""{_FILES}, {_BLOCKS},
hk AS (SELECT i.instance_id, i.repo, i.base_commit AS commit, regexp_replace(f.source, '^.*?a/', '') AS path, h.hs, h.ss - 15 AS a, h.ss - 15 + h.sl + 15 AS b
  FROM l5 l JOIN hh h ON h.id = l.id AND h.hs = l.hs AND l.is_hunk JOIN files f ON f.id = l.id AND f.file_no = l.file_no JOIN v_instances i ON i.number = l.id),
wn AS (SELECT h.instance_id, h.path, h.hs, CASE WHEN a > 0 THEN '...' || chr(10) ELSE '' END || coalesce((SELECT string_agg(nr || ' ' || line, chr(10) ORDER BY nr) FROM nl WHERE nl.repo = h.repo AND nl.commit = h.commit AND nl.path = h.path AND nl.nr > greatest(a, 0) AND nl.nr <= b), '')
  || chr(10) || CASE WHEN b < (SELECT count(*) FROM nl WHERE nl.repo = h.repo AND nl.commit = h.commit AND nl.path = h.path) THEN '...' || chr(10) ELSE '' END AS t FROM hk h),
pf AS (SELECT o.instance_id, o.path, '[start of ' || o.path || ']' || chr(10) || coalesce(string_agg(w.t, '' ORDER BY w.hs), '') AS t FROM ofi o JOIN nf USING (repo, commit, path) LEFT JOIN wn w ON w.instance_id = o.instance_id AND w.path = o.path GROUP BY 1, 2),
edits AS (SELECT instance_id, trim(string_agg(rtrim(t, chr(10)) || chr(10) || '[end of ' || path || ']' || chr(10), '' ORDER BY path), chr(10)) AS ce FROM pf GROUP BY 1)"""


def _edits(spark, sf_dir):
    lines, _ = _oracle(spark, sf_dir)
    files = diffs.diff_files(lines, "instance_id").select("instance_id", "file_no", F.expr("regexp_replace(source, '^.*?a/', '')").alias("path"))
    hunks = diffs.diff_hunks(lines, "instance_id").join(files, ["instance_id", "file_no"])
    return prompts.code_text_edits(_oracle_files(spark, sf_dir), hunks, KEYS)


@query("code_text_edits", f"WITH {_EDITS} SELECT instance_id, ce AS code_text FROM edits")
def _(spark, sf_dir):
    return _edits(spark, sf_dir)


@query("prompt_style2", _prompt_sql("cn", "rn", False, [_lit(P.ASK_PATCH_FOLLOWING), "'<patch>'", _lit(P.PATCH_EXAMPLE), "'</patch>'"]))
def _(spark, sf_dir):
    return _digest(_prompt(spark, sf_dir, "style-2"))


@query("prompt_style3", _prompt_sql("cn", "rn", True, [_lit(P.EXPLAIN_PATCH), "'<patch>'", _lit(P.PATCH_EXAMPLE), "'</patch>'", "''", _lit(P.ASK_PATCH_ABOVE), "'Respond below:'"]))
def _(spark, sf_dir):
    return _digest(_prompt(spark, sf_dir, "style-3"))


@query("prompt_full", _prompt_sql("cp", "rp", False, [_lit(P.ASK_FULL_FILES), "'<example>'", _lit(P.FULL_GENERATION_EXAMPLE), "'</example>'"]))
def _(spark, sf_dir):
    return _digest(_prompt(spark, sf_dir, "full_file_gen", numbered=False))


@query("prompt_edits", _prompt_sql("ce", "rn", False, [_lit(P.ASK_PATCH_FOLLOWING), "'<patch>'", _lit(P.PATCH_EXAMPLE), "'</patch>'"], _EDITS, "edits"))
def _(spark, sf_dir):
    return _digest(prompts.prompts(_instances(spark, sf_dir), _readmes(spark, sf_dir), _edits(spark, sf_dir), "style-2-edits-only", KEYS))


@query("context_oracle", f"WITH {_FILES}, {_BLOCKS} SELECT o.instance_id, 0 AS rank, o.path, b.content FROM ofi o JOIN blk b USING (repo, commit, path)")
def _(spark, sf_dir):
    return _oracle_files(spark, sf_dir)


@query("context_bm25", """SELECT i.instance_id, h.rank, f.path, f.content FROM v_instances i JOIN v_hits h ON h.instance_id = i.instance_id AND h.rank <= 4
  JOIN v_files f ON f.repo = i.repo AND f.commit = i.base_commit AND f.path = h.docid""")
def _(spark, sf_dir):
    return prompts.context_files("bm25", _instances(spark, sf_dir), load(spark, sf_dir, "v_files"), hits=load(spark, sf_dir, "v_hits"), k=4)


@query("context_all", """SELECT i.instance_id, 0 AS rank, f.path, md5(f.content) AS content FROM v_instances i JOIN v_files f ON f.repo = i.repo AND f.commit = i.base_commit
  WHERE f.path LIKE '%.py' AND NOT regexp_matches(f.path, '(^|[ _/.])(test|tests|testing)([ _/.]|$)')""")
def _(spark, sf_dir):
    out = prompts.context_files("all", _instances(spark, sf_dir), load(spark, sf_dir, "v_files"))
    return out.withColumn("content", F.md5("content"))


_TOK = "len(regexp_extract_all({t}, '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+|[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]'))"


@query("pack_budget", f"""WITH RECURSIVE {_FILES}, {_BLOCKS}, c AS (SELECT i.instance_id, h.rank, h.docid, {_TOK.format(t="rtrim(b.bn, chr(10))")} AS n FROM v_instances i JOIN v_hits h ON h.instance_id = i.instance_id
    JOIN blk b ON b.repo = i.repo AND b.commit = i.base_commit AND b.path = h.docid),
  b AS (SELECT instance_id, {_TOK.format(t="problem_statement")} + number % 100 AS base FROM v_instances),
  o AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY rank) AS i FROM c),
  r AS (SELECT instance_id, 0::BIGINT AS i, base::BIGINT AS used, '' AS files FROM b UNION ALL
    SELECT r.instance_id, o.i, CASE WHEN used + n < 300 THEN used + n ELSE used END, CASE WHEN used + n < 300 THEN files || o.docid || ',' ELSE files END FROM r JOIN o ON o.instance_id = r.instance_id AND o.i = r.i + 1)
  SELECT instance_id, arg_max(used, i) AS used, arg_max(files, i) AS files FROM r GROUP BY 1""")
def _(spark, sf_dir):
    inst = _instances(spark, sf_dir)
    # tokens once per file of a snapshot, not once per instance
    files = load(spark, sf_dir, "v_files").select(
        "repo", "commit", F.col("path").alias("docid"),
        tk.token_count(F.rtrim(prompts.file_block(F.col("path"), F.col("content")), F.lit("\n"))).alias("n"))
    ranked = load(spark, sf_dir, "v_hits").join(inst.select("instance_id", "repo", F.col("base_commit").alias("commit")), "instance_id").join(
        files, ["repo", "commit", "docid"])
    base = inst.select("instance_id", (tk.token_count(F.col("problem_statement")) + F.col("number") % 100).alias("base"))
    return prompts.pack_budget(ranked, base, 300).select(
        "instance_id", "used", F.concat_ws("", F.transform("files", lambda f: F.concat(f, F.lit(",")))).alias("files"))


view("v_prompted", """SELECT instance_id, repo, base_commit, '  ' || problem_statement || chr(10) || chr(9) AS text_inputs, patch, test_patch, version, hints_text, created_at,
  problem_statement, FAIL_TO_PASS, number FROM v_instances""")


@query("text_dataset", f"""SELECT instance_id, {st.strip('text_inputs')} || chr(10) || chr(10) AS text, repo, base_commit, problem_statement, hints_text, created_at,
  '<patch>' || chr(10) || patch || chr(10) || '</patch>' AS patch, coalesce(test_patch, '') AS test_patch, version, coalesce(FAIL_TO_PASS, '') AS FAIL_TO_PASS, '' AS PASS_TO_PASS, '' AS environment_setup_commit
  FROM v_prompted WHERE patch IS NOT NULL AND instance_id IN (SELECT instance_id FROM v_instances WHERE version LIKE '2.%' OR version LIKE '1.%')""")
def _(spark, sf_dir):
    split = _instances(spark, sf_dir).filter("version LIKE '2.%' OR version LIKE '1.%'")
    return prompts.text_dataset(load(spark, sf_dir, "v_prompted"), split)


@query("train_eval_split", """WITH e AS (SELECT instance_id, repo FROM v_instances WHERE repo LIKE 'org_1%')
  SELECT instance_id, repo, 'train' AS split FROM v_instances WHERE repo NOT IN (SELECT repo FROM e) UNION ALL SELECT *, 'eval' FROM e""")
def _(spark, sf_dir):
    raw = _instances(spark, sf_dir).select("instance_id", "repo")
    return prompts.train_eval_split(raw, raw.filter("repo LIKE 'org_1%'"))


@query("validation_split", "SELECT instance_id, CASE WHEN ('0x' || substr(md5('42:' || instance_id), 1, 8))::BIGINT % 1000000 < 50000 THEN 'validation' ELSE 'train' END AS split FROM v_instances")
def _(spark, sf_dir):
    return prompts.validation_split(_instances(spark, sf_dir).select("instance_id"), 0.05)


_ALL = "regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}\\p{Pc}]+|[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]')"
_VOCAB = f"""tok AS (SELECT doc_id, u.nr, u.token FROM (SELECT doc_id, {_ALL} AS ts FROM documents) d, unnest(d.ts) WITH ORDINALITY AS u(token, nr)),
voc AS (SELECT token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS id FROM tok GROUP BY 1),
ids AS (SELECT d.doc_id, coalesce(list(v.id ORDER BY t.nr) FILTER (v.id IS NOT NULL), []) AS ids FROM documents d LEFT JOIN tok t ON t.doc_id = d.doc_id LEFT JOIN voc v ON v.token = t.token GROUP BY 1)"""


@query("vocab", f"WITH {_VOCAB} SELECT token, n, id FROM voc")
def _(spark, sf_dir):
    return tk.vocabulary(load(spark, sf_dir, "documents"))


def _ids(spark, sf_dir):
    docs = tk.coded(load(spark, sf_dir, "documents"), "doc_id")
    return tk.token_ids(docs, tk.vocabulary(docs), "doc_id")


@query("token_ids", f"WITH {_VOCAB} SELECT doc_id, array_to_string(ids, ' ') AS input_ids FROM ids")
def _(spark, sf_dir):
    return _ids(spark, sf_dir).select("doc_id", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"))


def _pair(spark, sf_dir):
    return _ids(spark, sf_dir).select("doc_id", F.col("input_ids").alias("a"), F.reverse("input_ids").alias("b"))


def _shown(df, ids, labels):
    text = lambda c: F.array_join(c.cast("array<string>"), " ")
    return df.select("doc_id", text(ids).alias("input_ids"), text(labels).alias("labels"))


@query("train_labels", f"""WITH {_VOCAB} SELECT doc_id, array_to_string(ids || list_reverse(ids)[1:greatest(len(ids) - 1, 0)], ' ') AS input_ids,
  array_to_string(list_transform(range(len(ids) - 1), lambda x: -100::BIGINT) || list_reverse(ids), ' ') AS labels FROM ids""")
def _(spark, sf_dir):
    return _shown(_pair(spark, sf_dir), *prompts.train_labels(F.col("a"), F.col("b")))


@query("eval_labels", f"WITH {_VOCAB} SELECT doc_id, array_to_string(ids, ' ') AS input_ids, array_to_string(list_reverse(ids), ' ') AS labels FROM ids")
def _(spark, sf_dir):
    return _shown(_pair(spark, sf_dir), *prompts.eval_labels(F.col("a"), F.col("b")))


_ENDS = "CASE k % 4 WHEN 0 THEN '1 13 13' WHEN 1 THEN '1 13' WHEN 2 THEN '13' ELSE CAST(k AS STRING) || ' 7 13 5' END"


@query("append_terminator", f"SELECT k, s || CASE WHEN s LIKE '% 13 13' THEN '' ELSE ' 13' END AS ids FROM (SELECT k, {_ENDS} AS s FROM v_work)")
def _(spark, sf_dir):
    ids = F.split(F.expr(_ENDS), " ").cast("array<int>")
    out = prompts.append_terminator(ids, tk.NEWLINE_TOKEN)
    return load(spark, sf_dir, "v_work").select("k", F.array_join(out.cast("array<string>"), " ").alias("ids"))
