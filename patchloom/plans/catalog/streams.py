"""Source, sink and streaming queries. Files go to the checkpoint folder of the session."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import functions as F

from patchloom.operators import grade
from patchloom.plans.catalog.grading import KEYS, _RATES, _STATES, _states
from patchloom.plans.registry import query
from patchloom.plans.views import load, table
from patchloom.session import ensure_checkpoint_dir, pin, tidy_shuffles
from patchloom.sources import readers, writers
from patchloom.streaming import jobs


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/work/{uuid.uuid4().hex}/{name}"


def _stream(spark, sf_dir, name):
    """A given table as a file stream."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _in_batches(spark, rows, path, order, n=3):
    """``rows`` as a stream of ``n`` batches in the order of the column ``order``."""
    edges = rows.approxQuantile(order, [i / n for i in range(1, n)], 0.01)
    part = sum((F.col(order) > e).cast("int") for e in edges)
    for i in range(n):  # one after another: a file stream goes by time of writing
        rows.filter(part == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


_COLS = ", ".join(readers.INSTANCE.names)


@query("scan_instances", f"SELECT {_COLS} FROM v_instances")
def _(spark, sf_dir):
    path = _folder(spark, "instances.jsonl")
    writers.write_jsonl(load(spark, sf_dir, "v_instances").select(*readers.INSTANCE.names), path)
    return readers.read_instances(spark, path)


@query("merge_shards", "SELECT instance_id, repo, version FROM v_instances")
def _(spark, sf_dir):
    path = _folder(spark, "shards")
    rows = load(spark, sf_dir, "v_instances").select("instance_id", "repo", "version")
    writers.write_jsonl(rows, path, partition_by=["repo"])
    return writers.merge_shards(spark, path, rows.drop("repo").schema, rows.count()).withColumn(
        "repo", F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), "/repo=(.*)/[^/]*$", 1)
    ).withColumn("repo", F.url_decode("repo"))


@query("report_sink", f"""WITH {_STATES} SELECT state || '_ids' AS list_name, instance_id FROM states
  UNION ALL SELECT 'completed_ids', instance_id FROM states WHERE completed UNION ALL SELECT 'submitted_ids', instance_id FROM preds""")
def _(spark, sf_dir):
    path = _folder(spark, writers.report_name("org/model", "run"))
    with tidy_shuffles(spark):
        states, preds = _states(spark, sf_dir, partial(pin, compression="zstd"))
        writers.write_report(grade.run_report(states, preds), grade.run_report_ids(states, preds), path)
    return spark.read.schema("instance_id string, list_name string").json(f"{path}/ids").select("list_name", "instance_id")


@query("stream_ingest", "SELECT DISTINCT 'i-' || l_orderkey AS instance_id FROM lineitem")
def _(spark, sf_dir):
    root = _folder(spark, "ingest")
    preds = _in_batches(spark, table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), f"{root}/in", "l_partkey").select(
        F.concat(F.lit("i-"), F.col("l_orderkey").cast("string")).alias("instance_id"),
        F.concat(F.lit("patch "), F.col("l_partkey").cast("string")).alias("model_patch"),
    )
    jobs.run_available(preds, f"{root}/checkpoint", each=jobs.keep_first(f"{root}/out"))
    return spark.read.parquet(f"{root}/out").select("instance_id")


@query("stream_tally", "SELECT user_id, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    root = _folder(spark, "tally")
    counts = jobs.tally(_stream(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status")), ["user_id", "status"])
    jobs.run_available(counts, f"{root}/checkpoint", each=jobs.keep_latest_tally(f"{root}/out"), mode="complete")
    rows = spark.read.schema("user_id long, status string, n long, batch long").parquet(f"{root}/out")
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch").drop("batch")


@query("stream_grade", f"""WITH {_RATES} SELECT model, instance_id, CASE WHEN f2p_rate = 1 AND p2p_rate = 1 THEN 'RESOLVED_FULL'
  WHEN f2p_rate > 0 AND f2p_rate < 1 AND p2p_rate = 1 THEN 'RESOLVED_PARTIAL' ELSE 'RESOLVED_NO' END AS resolution FROM rates""")
def _(spark, sf_dir):
    root = _folder(spark, "grade")
    logs = load(spark, sf_dir, "v_logs")
    files = spark.sparkContext.defaultParallelism  # of each of three batches, so that all cores write and read them
    logs.repartition(3 * files, *KEYS).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    gold = pin(load(spark, sf_dir, "v_gold"))  # made once, not once a batch
    jobs.run_available(stream, f"{root}/checkpoint", each=jobs.grade_batches(gold, f"{root}/out", "pytest"))
    return spark.read.parquet(f"{root}/out").select(*KEYS, "resolution")


@query("stream_failures", """WITH e AS (SELECT event_id, event_type IN ('purchase', 'signup') AS ok FROM events), r AS (SELECT *, coalesce(sum(ok::INT) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run FROM e)
  SELECT run, min(event_id) AS first, count(*) AS length, count(*) >= 5 AS aborts FROM r WHERE NOT ok GROUP BY 1""")
def _(spark, sf_dir):
    root = _folder(spark, "failures")
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").isin("purchase", "signup").alias("ok"))
    rows = _in_batches(spark, events, f"{root}/in", "event_id", 4)
    jobs.run_available(rows, f"{root}/checkpoint", each=jobs.watch_failures(f"{root}/out", ["event_id"]))
    return jobs.failures_so_far(spark, f"{root}/out")


@query("predictions_from_files", """SELECT instance_id, arg_max(model_name_or_path, seq) AS model_name_or_path,
  nullif(arg_max(coalesce(model_patch, chr(0)), seq), chr(0)) AS model_patch FROM v_predictions GROUP BY 1""")
def _(spark, sf_dir):
    path = _folder(spark, f"{writers.output_name('org/model', 'org/data', 'test')}.jsonl")
    rows = load(spark, sf_dir, "v_predictions").sort("seq")  # files follow each other by name, and lines inside them
    writers.write_jsonl(rows.select("instance_id", "model_name_or_path", "model_patch"), path)
    return grade.latest_predictions(readers.read_predictions(spark, path)).select("instance_id", "model_name_or_path", "model_patch")
