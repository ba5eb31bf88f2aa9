"""Response ingest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.operators import ingest
from patchloom.plans import sqltext as st
from patchloom.plans.registry import query
from patchloom.plans.views import load, run_sql, view

ID = ["conv_id", "turn"]

# Requests: one per response turn, with a model and token counts.
_MODELS = ["claude-2", "gpt-4-0613", "gpt-4-32k-0613", "gpt-3.5-turbo-0613", "gpt-3.5-turbo-1106", "claude-3-haiku-20240307", "other"]
view(
    "v_requests",
    "SELECT o_orderkey AS id, CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MODELS))
    + " END AS model, CAST(FLOOR(o_totalprice / 10) AS BIGINT) AS n_tokens, CAST(FLOOR(o_totalprice / 10) AS BIGINT) AS tokens_in, "
    "CAST(50 + o_custkey % 1000 AS BIGINT) AS tokens_out FROM orders",
)


@query("extract_diff", """WITH t AS (SELECT conv_id, turn, text, list_concat(
    list_transform(['patch', 'diff', 'note', 'code', 'a', 'b'], lambda n: CASE WHEN regexp_matches(text, '(?s)<' || n || '>.*?</' || n || '>') THEN
      struct_pack(p := strpos(text, '<' || n || '>'), g := 0, n := n, b := split_part(substr(text, strpos(text, '<' || n || '>') + length(n) + 2), '</' || n || '>', 1)) END),
    CASE WHEN regexp_matches(text, '(?s)```([\\p{L}\\p{N}_]+)?\\n.*?```') THEN [struct_pack(p := strpos(text, '```'), g := 1, n := regexp_extract(text, '```([\\p{L}\\p{N}_]*)\\n', 1), b := regexp_extract(text, '(?s)```[\\p{L}\\p{N}_]*\\n(.*?)```', 1))] ELSE [] END) AS c FROM v_responses),
  s AS (SELECT conv_id, turn, text, list_sort(list_transform(list_filter(c, lambda x: x IS NOT NULL), lambda x: struct_pack(g := x.g, p := x.p, n := x.n, b := x.b))) AS c FROM t)
  SELECT conv_id, turn, coalesce(list_filter(c, lambda x: x.n IN ('diff', 'patch'))[1].b, c[1].b, split_part(text, '</s>', 1)) AS model_patch FROM s""")
def _(spark, sf_dir):
    return load(spark, sf_dir, "v_responses").select(*ID, ingest.extract_diff(F.col("text")).alias("model_patch"))


@query("length_filter", "SELECT id, n_tokens FROM v_requests WHERE n_tokens >= 500 AND n_tokens < 20000")
def _(spark, sf_dir):
    return ingest.length_filter(load(spark, sf_dir, "v_requests").select("id", "n_tokens"), F.col("n_tokens"), 500, 20000)


_LIMIT = "(VALUES ('claude-2', 100000), ('gpt-4-0613', 8192), ('gpt-4-32k-0613', 32768), ('gpt-3.5-turbo-0613', 4097), ('gpt-3.5-turbo-1106', 16385), ('claude-3-haiku-20240307', 200000)) m(model, lim)"


@query("context_limit", f"SELECT id, model, n_tokens, CASE WHEN lim IS NULL THEN 'unknown model' END AS error FROM v_requests LEFT JOIN {_LIMIT} USING (model) WHERE lim IS NULL OR n_tokens <= lim")
def _(spark, sf_dir):
    return ingest.context_limit(load(spark, sf_dir, "v_requests"), ingest.model_table(spark)).select("id", "model", "n_tokens", "error")


def _sized(spark, sf_dir):
    return load(spark, sf_dir, "v_requests").select("id", "n_tokens")


@query("order_short_first", "SELECT id, n_tokens, row_number() OVER (ORDER BY n_tokens, id) - 1 AS position FROM v_requests")
def _(spark, sf_dir):
    return ingest.short_first(_sized(spark, sf_dir), "n_tokens", "id")


@query("shard_contiguous", "SELECT id, n_tokens, row_number() OVER w - 1 AS position, ntile(6) OVER w - 1 AS shard FROM v_requests WINDOW w AS (ORDER BY n_tokens, id)")
def _(spark, sf_dir):
    return ingest.shard_contiguous(_sized(spark, sf_dir), "n_tokens", "id", 6)


@query("shard_modulo", "SELECT id, n_tokens, row_number() OVER w - 1 AS position, (row_number() OVER w - 1) % 6 AS shard FROM v_requests WINDOW w AS (ORDER BY n_tokens, id)")
def _(spark, sf_dir):
    return ingest.shard_modulo(_sized(spark, sf_dir), "n_tokens", "id", 6)


_OUT = """(SELECT CASE o_orderkey % 5 WHEN 0 THEN '{"instance_id": "i' || CAST(o_custkey AS STRING) || '", "x": 1}' WHEN 1 THEN '{"other": 1}' WHEN 2 THEN '{"instance_id": "broken'
  ELSE '{"model": "m", "instance_id": "j' || CAST(o_custkey AS STRING) || '"}' END AS value FROM orders)"""


@query("existing_ids", f"SELECT DISTINCT json_extract_string(value, '$.instance_id') AS instance_id FROM {_OUT} o WHERE json_valid(value) AND json_extract_string(value, '$.instance_id') IS NOT NULL")
def _(spark, sf_dir):
    return ingest.existing_ids(run_sql(spark, sf_dir, f"SELECT * FROM {_OUT} o"))


@query("subset_ids", "SELECT instance_id, repo FROM v_instances WHERE instance_id IN (SELECT instance_id FROM v_predictions WHERE model_patch IS NULL) ORDER BY created_at, instance_id LIMIT 50")
def _(spark, sf_dir):
    ids = load(spark, sf_dir, "v_predictions").filter("model_patch IS NULL")
    return ingest.subset(load(spark, sf_dir, "v_instances"), ids, 50, ["created_at", "instance_id"]).select("instance_id", "repo")


@query("token_estimate_text", "SELECT doc_id, greatest(1, length(text) // 3 + 32) AS n_tokens FROM documents")
def _(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", ingest.estimate_text_tokens(F.col("text")).alias("n_tokens"))


@query("token_estimate_chat", "SELECT conv_id, greatest(1, sum(length(coalesce(text, '')))::BIGINT // 3 + 16 + 4 * count(*)) AS n_tokens FROM v_responses GROUP BY 1")
def _(spark, sf_dir):
    return ingest.estimate_chat_tokens(load(spark, sf_dir, "v_responses"), "conv_id")


_BUDGET = "CASE WHEN lim IS NULL THEN CASE WHEN id % 2 = 0 THEN 500 ELSE 200 END WHEN lim - n_tokens - 64 <= 0 THEN NULL WHEN id % 2 = 0 THEN least(500, lim - n_tokens - 64) ELSE lim - n_tokens - 64 END"


def _budgets(spark, sf_dir):
    limits = ingest.model_table(spark).select("model", "max_tokens")
    rows = load(spark, sf_dir, "v_requests").join(limits, "model", "left")
    budget = ingest.output_budget(F.col("n_tokens"), F.when(F.col("id") % 2 == 0, 500).otherwise(-1), F.col("max_tokens"), 64)
    return rows.select("id", "model", budget.cast("long").alias("budget"))


@query("output_budget", f"SELECT id, model, {_BUDGET} AS budget FROM v_requests LEFT JOIN {_LIMIT} USING (model)")
def _(spark, sf_dir):
    return _budgets(spark, sf_dir)


@query("skip_summary", f"WITH b AS (SELECT model, {_BUDGET} AS budget FROM v_requests LEFT JOIN {_LIMIT} USING (model)) SELECT model, count(*) AS total, count(*) FILTER (budget IS NULL) AS skipped, round(100.0 * count(*) FILTER (budget IS NULL) / count(*), 6) AS percent FROM b GROUP BY 1")
def _(spark, sf_dir):
    return ingest.skip_summary(_budgets(spark, sf_dir), ["model"])


@query("truncate_on_repeat", """WITH w AS (SELECT conv_id, turn, text, unnest(range(1, length(text) - 100 + 2)) AS s FROM v_responses WHERE length(text) > 100),
  f AS (SELECT conv_id, turn, min(s) AS s FROM w WHERE len(list_distinct(string_split(substr(text, s, 100), ''))) < 10 GROUP BY 1, 2)
  SELECT r.conv_id, r.turn, CASE WHEN f.s IS NULL THEN r.text ELSE substr(r.text, 1, f.s - 1) END AS text FROM v_responses r LEFT JOIN f ON f.conv_id = r.conv_id AND f.turn = r.turn""")
def _(spark, sf_dir):
    return load(spark, sf_dir, "v_responses").select(*ID, ingest.truncate_on_repeat(F.col("text")).alias("text"))


_WORDS = "string_split(text, ' ')"


@query("truncate_tokens", """WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM v_responses WHERE text IS NOT NULL), w AS (SELECT conv_id, turn, ws, unnest(range(1, len(ws) - 20 + 2)) AS s FROM t WHERE len(ws) >= 20),
  f AS (SELECT conv_id, turn, min(s) AS s FROM w WHERE len(list_distinct(ws[s:s + 19])) <= 12 GROUP BY 1, 2)
  SELECT t.conv_id, t.turn, array_to_string(CASE WHEN f.s IS NULL THEN ws ELSE ws[1:f.s + 19] END, ' ') AS text FROM t LEFT JOIN f ON f.conv_id = t.conv_id AND f.turn = t.turn""")
def _(spark, sf_dir):
    words = F.split("text", " ")
    return load(spark, sf_dir, "v_responses").filter("text IS NOT NULL").select(
        *ID, F.array_join(ingest.truncate_tokens_on_repeat(words, 20, 12), " ").alias("text"))


_PRICE = """(VALUES ('claude-2', 11.02, 32.68), ('gpt-4-0613', 30.0, 60.0), ('gpt-4-32k-0613', 60.0, 120.0), ('gpt-3.5-turbo-1106', 1.0, 2.0), ('claude-3-haiku-20240307', 0.25, 1.25)) p(model, pin, pout)"""
_COST = f"c AS (SELECT id, model, CAST((pin::DECIMAL(18,2) * tokens_in + pout::DECIMAL(18,2) * tokens_out) * 100 AS BIGINT) AS units, CASE WHEN pin IS NULL THEN 'no price' END AS error FROM v_requests LEFT JOIN {_PRICE} USING (model))"


def _costs(spark, sf_dir):
    return ingest.costs(load(spark, sf_dir, "v_requests"), ingest.model_table(spark))


def _dollars(c):
    return F.round(F.col(c).cast("double"), 6)


@query("cost_by_model", f"WITH {_COST} SELECT model, count(*) AS n, round(sum(units)::DOUBLE / 1e8, 6) AS cost, max(error) AS error FROM c GROUP BY 1")
def _(spark, sf_dir):
    return ingest.cost_by_model(_costs(spark, sf_dir)).withColumn("cost", _dollars("cost"))


@query("cost_cap", f"""WITH {_COST}, r AS (SELECT *, coalesce(sum(units) OVER (PARTITION BY model ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
  SELECT id, model, units, before::BIGINT AS units_before, error FROM r WHERE before < 2500000000""")
def _(spark, sf_dir):
    kept = ingest.cost_cap(_costs(spark, sf_dir), ["id"], 25.0)
    units = lambda c: (F.col(c) * 100_000_000).cast("long")
    return kept.select("id", "model", units("cost").alias("units"), units("cost_before").alias("units_before"), "error")


_ARGS = """(SELECT event_id, 'k=' || CAST(user_id AS STRING) || CASE event_id % 6 WHEN 0 THEN ',a=True,b=None' WHEN 1 THEN ',t=0.' || CAST(event_id % 10 AS STRING) || ',u=1.2.3' WHEN 2 THEN ',l=[],d={}'
  WHEN 3 THEN ',q=''x y'',r="z"' WHEN 4 THEN ',e=,f=.5,g=7.' ELSE ',s=' || event_type || ',h=False' END AS args FROM events)"""


@query("kv_typed", f"""WITH p AS (SELECT event_id, unnest(string_split(args, ',')) AS pair FROM {_ARGS} a), s AS (SELECT event_id, split_part(pair, '=', 1) AS name, split_part(pair, '=', 2) AS v FROM p)
  SELECT event_id, name, CASE WHEN v IN ('True', 'False') THEN 'bool' WHEN regexp_matches(v, '^[0-9]+$') THEN 'int' WHEN regexp_matches(v, '^([0-9]+[.][0-9]*|[.][0-9]+)$') THEN 'float' WHEN v = 'None' THEN 'none'
    WHEN v = '[]' THEN 'list' WHEN v = '{{}}' THEN 'dict' ELSE 'str' END AS kind,
    CASE WHEN v = 'None' THEN NULL WHEN regexp_matches(v, '^(''.*''|".*")$') THEN v[2:-2] ELSE v END AS value FROM s""")
def _(spark, sf_dir):
    return ingest.typed_arguments(run_sql(spark, sf_dir, f"SELECT * FROM {_ARGS} a"), "event_id")


_CHAT = "(SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'Be brief.' WHEN 1 THEN '  ' || chr(9) END AS system_prompt FROM documents)"


@query("messages", f"""SELECT doc_id, 0 AS pos, 'system' AS role, system_prompt AS content FROM {_CHAT} c WHERE {st.strip('system_prompt')} <> ''
  UNION ALL SELECT doc_id, CASE WHEN {st.strip('system_prompt')} <> '' THEN 1 ELSE 0 END, 'user', text FROM {_CHAT} c""")
def _(spark, sf_dir):
    return ingest.build_messages(run_sql(spark, sf_dir, f"SELECT * FROM {_CHAT} c"), "doc_id")


@query("split_system_user", """SELECT doc_id, split_part(text, chr(10), 1) AS system, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) END AS "user" FROM documents""")
def _(spark, sf_dir):
    system, user = ingest.split_system_user(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", system.alias("system"), user.alias("user"))


_WORD = "CASE event_id % 11 WHEN 0 THEN 'YES' WHEN 1 THEN 'no' WHEN 2 THEN 'T' WHEN 3 THEN 'False' WHEN 4 THEN '1' WHEN 5 THEN '0' WHEN 6 THEN 'None' WHEN 7 THEN '' WHEN 8 THEN 'NULL' WHEN 9 THEN event_type ELSE 'y' END"


@query("normalize_flags", f"""SELECT event_id, CASE WHEN lower(v) IN ('yes', 'true', 't', 'y', '1') THEN true WHEN lower(v) IN ('no', 'false', 'f', 'n', '0') THEN false END AS flag,
  CASE WHEN lower(v) NOT IN ('yes', 'true', 't', 'y', '1', 'no', 'false', 'f', 'n', '0') THEN 'boolean value expected' END AS error,
  CASE WHEN lower(v) NOT IN ('none', 'null', '') THEN v END AS text FROM (SELECT event_id, {_WORD} AS v FROM events)""")
def _(spark, sf_dir):
    v = F.expr(_WORD)
    return load(spark, sf_dir, "events").select(
        "event_id", ingest.normalize_flag(v).alias("f"), ingest.normalize_null(v).alias("text")).select("event_id", "f.flag", "f.error", "text")


@query("failure_runs", """WITH e AS (SELECT event_id, event_type NOT IN ('error', 'view', 'click') AS ok FROM events), r AS (SELECT *, coalesce(sum(ok::INT) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run FROM e)
  SELECT run, min(event_id) AS first, count(*) AS length, count(*) >= 5 AS aborts FROM r WHERE NOT ok GROUP BY 1""")
def _(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", (~F.col("event_type").isin("error", "view", "click")).alias("ok"))
    return ingest.failure_runs(rows, ["event_id"])
