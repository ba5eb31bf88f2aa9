"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from patchloom.llm import bpe, lattice, metric_trees, mixing, negatives, omh, passages, pii, reputation, sharding, sketches, toxicity, warc
from patchloom.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary.from_file(VOCABULARY_FILE, public_tokenizers.PATTERN)
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary)


RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)
_RULE_ROWS = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '{r[r.index('/'):]}')" for v, r in RULES)
_SQ = "round({b}::DOUBLE * {b} / nullif({n}, 0), 6)::DECIMAL(38,6)"


def _weight(child: str, parent: str) -> str:
    """SQL of the prior's weight; the columns of ``t`` are named as in the operator."""
    groups, squares, share = (f"{child}_groups", f"{child}_sq", f"{child}_share")
    within = f"((bad - {parent}_sq) / n)"
    freedom = f"({groups} - {parent}_groups)"
    room = f"({within} * (n - {share} - {freedom}))"
    excess = f"(({squares} - {parent}_sq - {within} * {freedom}) / {room})"
    return f"CASE WHEN n = 0 THEN 10000.0 WHEN {room} <= 0 THEN 10000.0 WHEN {excess} <= 0 THEN 10000.0 ELSE least(10000.0, greatest(0.5, 1 / least({excess}, 1.0) - 1)) END"


HOST_REPUTATION_SQL = f"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(verdict, rule, rh, rp) AS (VALUES {_RULE_ROWS}),
ruled AS (SELECT h.*, (SELECT arg_max(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule)) FROM r
  WHERE (h.host = r.rh OR ends_with(h.host, '.' || r.rh)) AND starts_with(h.path, r.rp)) AS m FROM h),
hosts AS (SELECT host, count(m) AS n, count(*) FILTER (m.verdict = 'block') AS b,
  array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, string_split(host, '.')[-1] AS suffix FROM ruled GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(b) AS b, sum(n * n) AS n2, count(*) FILTER (n > 0) AS hosts,
  sum({_SQ.format(b='b', n='n')}) FILTER (n > 0) AS sq FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(b) AS b, sum(n * n) AS n2, count(*) FILTER (n > 0) AS domains, sum(hosts) AS hosts, sum(sq) AS host_sq,
  sum({_SQ.format(b='b', n='n')}) FILTER (n > 0) AS domain_sq, sum(round(n2::DOUBLE / nullif(n, 0), 6)::DECIMAL(38,6)) FILTER (n > 0) AS share FROM domains GROUP BY ALL),
t AS (SELECT coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(b), 0)::DOUBLE AS bad, 1 AS all_groups, coalesce(sum(b)::DOUBLE * sum(b) / sum(n), 0) AS all_sq,
  count(*) AS suffix_groups, coalesce(sum({_SQ.format(b='b', n='n')}), 0)::DOUBLE AS suffix_sq, coalesce(sum(n * n)::DOUBLE / sum(n), 0) AS suffix_share,
  coalesce(sum(domains), 0) AS domain_groups, coalesce(sum(domain_sq), 0)::DOUBLE AS domain_sq, coalesce(sum(round(n2::DOUBLE / nullif(n, 0), 6)::DECIMAL(38,6)), 0)::DOUBLE AS domain_share,
  coalesce(sum(hosts), 0) AS host_groups, coalesce(sum(host_sq), 0)::DOUBLE AS host_sq, coalesce(sum(share), 0)::DOUBLE AS host_share FROM suffixes WHERE n > 0),
w AS (SELECT n, bad, {_weight('suffix', 'all')} AS ws, {_weight('domain', 'suffix')} AS wd, {_weight('host', 'domain')} AS wh FROM t),
sm AS (SELECT suffix, (b + ws * ((bad + 0.5) / (w.n + 1))) / (s.n + ws) AS m FROM suffixes s, w),
dm AS (SELECT domain, (b + wd * m) / (d.n + wd) AS m FROM domains d JOIN sm USING (suffix), w),
hm AS (SELECT host, (b + wh * m) / (h.n + wh) AS m, h.n, wh FROM hosts h JOIN dm USING (domain), w),
bounds AS (SELECT host, m - 1.645 * sqrt(m * (1 - m) / (n + (wh + 1))) AS bound FROM hm)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, CASE WHEN bound >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(bound, 9) AS bound
FROM ruled JOIN bounds USING (host)
"""


@query("op4_host_reputation", HOST_REPUTATION_SQL)
def host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = reputation.judge_urls(table(spark, sf_dir, "pages"), RULES)
    return judged.withColumn("bound", F.round("bound", 9))


SHARDS = 24


@query("op5_jump_shards")
def jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)


MIX_WEIGHTS, MIX_TOTAL, MIX_MOST = (3, 1, 2), 1.5, 2


@query("op6_pivotal_mix")
def pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_TOTAL, MIX_MOST)


CAPTURES_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
b AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS best FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN best <> page_id THEN best END AS refers_to FROM b
"""


@query("op2_warc_transactions", CAPTURES_SQL)
def warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/archives/{uuid.uuid4().hex}"
    return warc.capture_digests(table(spark, sf_dir, "pages"), path)


@query("op7_order_minhash")
def order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.edit_fingerprints(table(spark, sf_dir, "documents"))


@query("op3_noisy_channel_toxicity")
def noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_REACHED = """reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)"""

# every pair that shares a shingle, and all that links reach
NEAR_DUPLICATES_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), {_REACHED}
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(least.b, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(least.b, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = w.doc_id
"""


@query("op9_bottom_k_sketches", NEAR_DUPLICATES_SQL)
def bottom_k_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


PASSAGES_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN again USING (h))),
words AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


@query("op10_phrase_automata", PASSAGES_SQL)
def phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


LATTICE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
u AS (SELECT vec_id, label, x, sqrt(list_inner_product(x, x)) AS n FROM v),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.x) = len(q.x) WHERE list_inner_product(p.x, q.x) / (p.n * q.n) >= 0.98),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), {_REACHED},
degree AS (SELECT a, count(*) AS n FROM both_ways GROUP BY 1)
SELECT e.vec_id, coalesce(degree.n, 0) AS n_links, least(e.vec_id, coalesce(least.b, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(least.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN degree ON degree.a = e.vec_id LEFT JOIN least ON least.a = e.vec_id
"""


@query("op1_lattice_hashing", LATTICE_SQL)
def lattice_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


HARD_NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score
  FROM v JOIN (SELECT * FROM v WHERE vec_id % 100 = 0) a ON a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@query("op11_strassen_negatives", HARD_NEGATIVES_SQL)
def strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=shifted)


def _round(k: int) -> str:
    """Assignment to codebook ``k``, and codebook ``k + 1``."""
    return f"""a{k} AS MATERIALIZED (SELECT vec_id, part, any_value(v) AS v, min(struct_pack(d := list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c), i := i)) AS best
  FROM p JOIN c{k} USING (part) GROUP BY vec_id, part),
m{k} AS (SELECT part, i, list(floor(s / n) ORDER BY k) AS c FROM (SELECT part, best.i AS i, k, sum(x) AS s, count(*) AS n
  FROM (SELECT part, best, unnest(v) AS x, unnest(range(len(v))) AS k FROM a{k}) GROUP BY ALL) GROUP BY part, i),
c{k + 1} AS MATERIALIZED (SELECT part, i, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (part, i))"""


METRIC_TREES_SQL = f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, q[part * (len(q) // 4) + 1:(part + 1) * (len(q) // 4)] AS v FROM k, range(4) t(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS i, v AS c FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256)),
{", ".join(_round(k) for k in range(5))},
coded AS (SELECT vec_id, string_agg(lower(printf('%02x', best.i::INT)), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a4 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, i, k)) AS sha FROM (SELECT part, i, unnest(c) AS x, unnest(range(len(c))) AS k FROM c4))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM coded JOIN k USING (vec_id), books
"""


@query("op12_metric_trees", METRIC_TREES_SQL)
def tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_trees.compress(table(spark, sf_dir, "embeddings"))


@query("op13_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    return found.select(
        "doc_id", *(F.size(F.filter(kinds, lambda x: x == kind)).cast("long").alias(f"n_{kind}") for kind in pii.BASE),
        F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))
