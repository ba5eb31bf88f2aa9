"""Diff queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.operators import diffs
from patchloom.plans import sqltext as st
from patchloom.plans.registry import query
from patchloom.plans.views import load, run_sql

# --- SQL side: line table of the diffs ------------------------------------------------

_LINES = f"""{st.lines_cte('v_diffs', 'id', 'patch', 'raw')},
l0 AS (SELECT id, line_no, line FROM raw QUALIFY NOT (line = '' AND line_no = max(line_no) OVER (PARTITION BY id)) ),
l1 AS (SELECT *, regexp_matches(line, '^@@ -[0-9]+(,[0-9]+)? [+][0-9]+(,[0-9]+)? @@') AS is_hunk FROM l0),
l2 AS (SELECT *, sum(is_hunk::INT) OVER w AS hs FROM l1 WINDOW w AS (PARTITION BY id ORDER BY line_no)),
hh AS (SELECT id, hs, line_no AS h_no, regexp_extract(line, '^@@ -([0-9]+)(,([0-9]+))? [+]([0-9]+)(,([0-9]+))? @@', 1)::BIGINT AS ss,
  coalesce(nullif(regexp_extract(line, '^@@ -([0-9]+)(,([0-9]+))? ', 3), '')::BIGINT, 1) AS sl,
  regexp_extract(line, '[+]([0-9]+)(,([0-9]+))? @@', 1)::BIGINT AS ts, coalesce(nullif(regexp_extract(line, '[+]([0-9]+)(,([0-9]+))? @@', 3), '')::BIGINT, 1) AS tl
  FROM l2 WHERE is_hunk),
l3 AS (SELECT l.*, h.sl, h.tl, count(*) FILTER (line_no > h_no AND line[1:1] IN ('', ' ', '-')) OVER w AS pre,
  count(*) FILTER (line_no > h_no AND line[1:1] IN ('', ' ', '+')) OVER w AS post, h_no FROM l2 l LEFT JOIN hh h ON h.id = l.id AND h.hs = l.hs
  WINDOW w AS (PARTITION BY l.id, l.hs ORDER BY l.line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l4 AS (SELECT *, h_no IS NOT NULL AND line_no > h_no AND (pre < sl OR post < tl) AS inh FROM l3),
l5 AS (SELECT *, CASE WHEN is_hunk THEN 'hunk' WHEN NOT inh THEN 'meta' WHEN line[1:1] = '+' THEN 'added' WHEN line[1:1] = '-' THEN 'removed' ELSE 'context' END AS kind,
  sum((NOT inh AND line LIKE 'diff --git %')::INT) OVER (PARTITION BY id ORDER BY line_no) AS file_no FROM l4)"""
_FILES = f"""{_LINES},
f0 AS (SELECT id, file_no, coalesce(min(CASE WHEN kind = 'meta' AND line LIKE '--- %' THEN line[5:] END), min(CASE WHEN line LIKE 'diff --git %' THEN regexp_extract(line, '(a/.*) b/', 1) END)) AS source,
  coalesce(min(CASE WHEN kind = 'meta' AND line LIKE '+++ %' THEN line[5:] END), min(CASE WHEN line LIKE 'diff --git %' THEN regexp_extract(line, ' (b/.*)$', 1) END)) AS target,
  count(*) FILTER (kind = 'hunk') AS n_hunks, count(*) FILTER (kind = 'added') AS n_added, count(*) FILTER (kind = 'removed') AS n_removed,
  string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS text FROM l5 WHERE file_no > 0 GROUP BY 1, 2),
files AS (SELECT *, CASE WHEN source = '/dev/null' THEN target[3:] WHEN target = '/dev/null' OR source[3:] = target[3:] THEN source[3:] ELSE target[3:] END AS path,
  CASE WHEN source = '/dev/null' THEN 'added' WHEN target = '/dev/null' THEN 'removed' ELSE 'modified' END AS kind FROM f0)"""


def _lines(spark, sf_dir):
    return diffs.diff_lines(load(spark, sf_dir, "v_diffs").select("id", "patch"))


def _files(spark, sf_dir, with_text=False):
    return diffs.diff_files(_lines(spark, sf_dir), with_text=with_text)


@query("diff_lines", f"WITH {_LINES} SELECT id, line_no::INTEGER AS line_no, line, file_no::BIGINT AS file_no, CASE WHEN is_hunk OR inh THEN hs END::BIGINT AS hunk_no, kind FROM l5")
def _(spark, sf_dir):
    return _lines(spark, sf_dir)


@query("diff_files", f"WITH {_FILES} SELECT id, file_no::BIGINT AS file_no, source, target, path, kind, n_hunks, n_added, n_removed FROM files")
def _(spark, sf_dir):
    return _files(spark, sf_dir)


@query("diff_hunks", f"""WITH {_LINES} SELECT l.id, l.file_no::BIGINT AS file_no, l.hs::BIGINT AS hunk_no, h.ss AS source_start, h.sl AS source_len, h.ts AS target_start, h.tl AS target_len,
  count(*) FILTER (kind = 'context') AS n_context, count(*) FILTER (kind = 'added') AS n_added, count(*) FILTER (kind = 'removed') AS n_removed
  FROM l5 l JOIN hh h ON h.id = l.id AND h.hs = l.hs WHERE l.is_hunk OR l.inh GROUP BY ALL""")
def _(spark, sf_dir):
    return diffs.diff_hunks(_lines(spark, sf_dir))


@query("diff_stats", f"""WITH {_FILES} SELECT kind, count(*) AS n_files, sum(n_hunks)::BIGINT AS n_hunks, sum(n_added)::BIGINT AS n_added, sum(n_removed)::BIGINT AS n_removed FROM files GROUP BY 1""")
def _(spark, sf_dir):
    return _files(spark, sf_dir).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_files"), *[F.sum(c).alias(c) for c in ("n_hunks", "n_added", "n_removed")]
    )


@query("modified_files", f"WITH {_FILES} SELECT id, file_no::BIGINT AS file_no, source[3:] AS path FROM files WHERE source <> '/dev/null'")
def _(spark, sf_dir):
    return diffs.modified_files(_files(spark, sf_dir))


@query("new_files", f"WITH {_FILES} SELECT id, file_no::BIGINT AS file_no, target[3:] AS path FROM files WHERE source = '/dev/null'")
def _(spark, sf_dir):
    return diffs.new_files(_files(spark, sf_dir))


@query("oracle_files", f"WITH {_FILES} SELECT DISTINCT id, regexp_replace(source, '^.*?a/', '') AS path FROM files")
def _(spark, sf_dir):
    return diffs.oracle_files(_files(spark, sf_dir))


@query("split_patch", f"""WITH {_FILES} SELECT id, coalesce(string_agg(text, '' ORDER BY file_no) FILTER (NOT (contains(path, 'test') OR contains(path, 'e2e'))), '') AS patch,
  coalesce(string_agg(text, '' ORDER BY file_no) FILTER (contains(path, 'test') OR contains(path, 'e2e')), '') AS test_patch FROM files GROUP BY 1""")
def _(spark, sf_dir):
    return diffs.split_patch(_files(spark, sf_dir, with_text=True))


@query("is_test_path", f"WITH {_FILES} SELECT DISTINCT path, len(list_intersect(regexp_split_to_array(lower(path), '[ _/.]'), ['test', 'tests', 'testing'])) > 0 AS is_test FROM files")
def _(spark, sf_dir):
    return _files(spark, sf_dir).select("path", diffs.is_test_path(F.col("path")).alias("is_test")).distinct()


@query("test_directives", """WITH d AS (SELECT instance_id, repo, unnest(regexp_extract_all(test_patch, 'diff --git a/.* b/(.*)', 1)) AS d,
  generate_subscripts(regexp_extract_all(test_patch, 'diff --git a/.* b/(.*)', 1), 1) AS nr FROM v_instances),
  k AS (SELECT * FROM d WHERE NOT regexp_matches(d, '([.](json|png|txt|md|jpg|jpeg|pkl|yml|yaml|toml)|csv)$'))
  SELECT instance_id, (row_number() OVER (PARTITION BY instance_id ORDER BY nr) - 1)::INTEGER AS pos,
  CASE WHEN repo = 'django/django' THEN replace(regexp_replace(regexp_replace(d, '[.]py$', ''), '^tests/', ''), '/', '.') ELSE d END AS directive FROM k""")
def _(spark, sf_dir):
    return diffs.test_directives(load(spark, sf_dir, "v_instances"))


_VERSION = "CASE id % 3 WHEN 0 THEN '10.10.0' WHEN 1 THEN '8.9.3' ELSE '12.0.0' END"


@query("test_commands", f"""WITH {_FILES}, p AS (SELECT id, file_no, {_VERSION} AS version,
    CASE WHEN regexp_matches(path, '__snapshots__/.*.js.snap$') THEN regexp_replace(path, '/[^/]*/[^/]*$', '') ELSE path END AS path FROM files),
  c AS (SELECT id, file_no, CASE WHEN regexp_matches(path, '^(client|packages)') THEN [CASE version WHEN '10.10.0' THEN './node_modules/.bin/jest --verbose -c=test/' || split_part(path, '/', 1) || '/jest.config.js ''' || path || ''''
      WHEN '8.9.3' THEN './node_modules/.bin/jest --verbose -c=test/' || split_part(path, '/', 1) || '/jest.config.json ''' || path || ''''
      ELSE 'npm run test-' || split_part(path, '/', 1) || ' --verbose ''' || path || '''' END]
    WHEN path LIKE 'test/e2e%' THEN ['cd test/e2e', 'NODE_CONFIG_ENV=test npm run test ' || path, 'cd ../..'] END AS cmds FROM p)
  SELECT id, file_no::BIGINT AS file_no, (nr - 1)::INTEGER AS pos, command FROM (SELECT id, file_no, unnest(cmds) AS command, generate_subscripts(cmds, 1) AS nr FROM c)""")
def _(spark, sf_dir):
    return diffs.js_test_commands(_files(spark, sf_dir).withColumn("version", F.expr(_VERSION)))


_ASSETS = """(SELECT page_id, '{"test_patch": [{"path": "' || CASE page_id % 3 WHEN 0 THEN 'x.png' WHEN 1 THEN 'img/deep/x.png' ELSE '/x.png' END || '", "url": "' || url
  || '"}, {"path": "b/y.png", "url": "u"}]}' AS image_assets FROM pages)"""


@query("image_assets", f"""SELECT page_id, pos::INTEGER AS pos, CASE WHEN regexp_matches(path, '^[^/]*$') THEN '.' WHEN regexp_matches(path, '^/[^/]*$') THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS folder, path, url
  FROM (SELECT page_id, i.i AS pos, json_extract_string(image_assets, '$.test_patch[' || i.i || '].path') AS path, json_extract_string(image_assets, '$.test_patch[' || i.i || '].url') AS url
  FROM {_ASSETS} a, (VALUES (0), (1)) i(i))""")
def _(spark, sf_dir):
    return diffs.image_assets(run_sql(spark, sf_dir, f"SELECT * FROM {_ASSETS} a"), "page_id")


# --- SQL side of the rebuilt patches: cut marks in place of look-ahead ------------------


def _rebuilt(trim: bool, blank: str) -> str:
    mark = ("regexp_replace(regexp_replace(ltrim(patch, chr(10)), '(diff |--- a/)', chr(1) || '\\1', 'g'), '(@@ -)', chr(2) || '\\1', 'g')")
    hunk = r"@@\s+-([0-9]+),([0-9]+)\s+\+([0-9]+),([0-9]+)\s+@@([^\x01\x02]+)"
    if trim:
        body = f"""h2 AS (SELECT *, list_transform(ls, lambda x: x[1:1] IN ('-', '+')) AS ch FROM h1),
          h3 AS (SELECT *, list_position(ch, true) AS a, len(ls) - list_position(list_reverse(ch), true) + 1 AS z FROM h2),
          h4 AS (SELECT id, f, h, head, start + a - 2 AS start, list_transform(ls[a:z + 1], lambda x: CASE WHEN rtrim(x, {st.WS}) = '' THEN '{blank}' ELSE rtrim(x, {st.WS}) END) AS kept FROM h3),
          h5 AS (SELECT *, chr(10) || array_to_string(kept, chr(10)) || chr(10) AS content, string_split(trim(array_to_string(kept, chr(10)), chr(10)), chr(10)) AS cnt FROM h4)"""
        head = "regexp_extract(c, '--- a/.+\\n[+]{3} b/.+')"
    else:
        body = """h5 AS (SELECT *, array_to_string(ls, chr(10)) AS content, string_split(trim(array_to_string(ls[2:], chr(10)), chr(10)), chr(10)) AS cnt FROM h1)"""
        head = "CASE WHEN prefix(c, chr(1) || 'diff') THEN regexp_extract(c, 'diff.*') || chr(10) ELSE '' END || regexp_extract(c, '--- a/.+\\n[+]{3} b/.+')"
    return f"""WITH m AS (SELECT id, patch, {mark} AS t FROM v_diffs),
      c AS (SELECT id, u.c, u.nr AS f FROM (SELECT id, regexp_extract_all(t, '(?s)(\\x01diff[\\w_. /-]+\\n)?\\x01--- *a/.*?\\n\\+\\+\\+\\s+b/[^\\x01]*') AS cs FROM m) s, unnest(s.cs) WITH ORDINALITY AS u(c, nr)),
      h0 AS (SELECT id, f, {head} AS head, regexp_extract_all(c, '{hunk}', 1) AS st, regexp_extract_all(c, '{hunk}', 5) AS ct FROM c),
      h1 AS (SELECT id, f, head, generate_subscripts(st, 1) AS h, unnest(st)::BIGINT AS start, string_split(unnest(ct), chr(10)) AS ls FROM h0),
      {body},
      h6 AS (SELECT *, len(list_filter(cnt, lambda x: x[1:1] = '+')) AS ad, len(list_filter(cnt, lambda x: x[1:1] = '-')) AS su, len(cnt) AS al FROM h5),
      h7 AS (SELECT *, coalesce(sum(ad - su) OVER (PARTITION BY id, f ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sh FROM h6),
      g AS (SELECT id, f, string_agg('@@ -' || start || ',' || (al - ad) || ' +' || (start + sh) || ',' || (al - su) || ' @@' || content, '' ORDER BY h) AS hunks FROM h7 GROUP BY 1, 2),
      o AS (SELECT h0.id, string_agg(replace(replace(head || chr(10) || coalesce(hunks, ''), chr(1), ''), chr(2), ''), '' ORDER BY h0.f) AS built FROM h0 LEFT JOIN g ON g.id = h0.id AND g.f = h0.f GROUP BY 1)
      SELECT m.id, CASE WHEN m.patch IS NOT NULL THEN coalesce(o.built, '') END AS patch FROM m LEFT JOIN o ON o.id = m.id"""


def _rebuild(spark, sf_dir, **kw):
    return diffs.rebuild_patch(load(spark, sf_dir, "v_diffs").select("id", "patch"), **kw)


@query("minimal_patch", _rebuilt(True, " "))
def _(spark, sf_dir):
    return _rebuild(spark, sf_dir)


@query("minimal_patch_raw", _rebuilt(True, ""))
def _(spark, sf_dir):
    return _rebuild(spark, sf_dir, blank_as_space=False)


@query("repair_patch", _rebuilt(False, ""))
def _(spark, sf_dir):
    return _rebuild(spark, sf_dir, trim=False)
