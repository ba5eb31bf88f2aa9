"""Plan shapes, and streams against their batch form."""

import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from patchloom.operators import ingest
from patchloom.plans.registry import QUERIES
from patchloom.streaming import jobs
import patchloom.plans.catalog  # noqa: F401

SF = "/root/testdata/sf0.001"
JVM_ONLY = ["log_status", "parse_pytest", "parse_gotest", "parse_django", "parse_maven", "diff_files", "minimal_patch", "bm25_topk",
            "asof_release", "pack_budget", "extract_diff", "truncate_on_repeat", "resolved_issues", "lite_flags", "token_ids"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JVM_ONLY)
def test_no_python_in_the_plan(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not re.search(r"(BatchEvalPython|ArrowEvalPython|MapInPandas|CartesianProduct)", text)


@pytest.mark.parametrize("name", ["grade_tests", "predictions_last_wins", "diff_files", "bm25_topk", "asof_release", "parse_pytest", "hints_takewhile"])
def test_facts_stay_distributed(spark, name):
    assert "SinglePartition" not in plan(QUERIES[name](spark, SF))


def test_limits_are_cut_before_the_shuffle(spark):
    for name in ("limit_pulls", "finetune_pool"):
        assert "WindowGroupLimit" in plan(QUERIES[name](spark, SF))
    assert "TakeOrderedAndProject" in plan(QUERIES["lite_sample"](spark, SF))


def test_scan_reads_only_needed_columns(spark):
    text = plan(QUERIES["transition_classes"](spark, SF))
    assert "l_extendedprice" not in text and "o_totalprice" not in text


def test_failure_watch_carries_over_batches(spark, tmp_path):
    flags = [1, 0, 0, 0, 0, 0, 0, 1, 0, 1, 1, 0, 0]
    rows = spark.createDataFrame([(i, bool(f)) for i, f in enumerate(flags)], "seq long, ok boolean")
    for lo, hi in ((0, 4), (4, 6), (6, 13)):  # the run of six failures spans three files
        rows.filter((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.run_available(stream, f"{tmp_path}/ckpt", each=jobs.watch_failures(f"{tmp_path}/out", ["seq"]))
    found = sorted(map(tuple, jobs.failures_so_far(spark, f"{tmp_path}/out").select("run", "first", "length", "aborts").collect()))
    whole = sorted(map(tuple, ingest.failure_runs(rows, ["seq"]).select("run", "first", "length", "aborts").collect()))
    assert found == whole and max(r[2] for r in found) == 6


def test_ingest_with_bounded_state(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "instance_id string, s long").withColumn("t", F.timestamp_seconds("s")).drop("s")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    jobs.run_available(jobs.first_predictions(stream, "t", "1 hour"), f"{tmp_path}/ckpt", f"{tmp_path}/out")
    assert sorted(r["instance_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_ingest_resumes_from_its_checkpoint(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "instance_id string, model_patch string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema("instance_id string, model_patch string").json(f"{tmp_path}/in")
        jobs.run_available(stream, f"{tmp_path}/ckpt", each=jobs.keep_first(f"{tmp_path}/out"))
        return sorted(r["instance_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    write([("a", "1"), ("b", "1"), ("a", "2")])
    assert run() == ["a", "b"]
    write([("b", "3"), ("c", "1")])
    assert run() == ["a", "b", "c"]


def test_graded_batches_are_dealt_out(spark, tmp_path, monkeypatch):
    """A batch of one file would be written and read by one task, however many logs there are."""
    rows = {
        "orders": "id o_orderkey, id o_custkey, 'O' o_orderstatus, 1.0D o_totalprice, timestamp'1995-01-01' o_orderdate, 'm' o_orderpriority",
        "customer": "id c_custkey, 'c' c_name, cast(id % 5 AS int) c_nationkey, 1.0D c_acctbal, 's' c_mktsegment",
        "nation": "cast(id AS int) n_nationkey, 'n' n_name, 0 n_regionkey",
        "lineitem": "id % 300 l_orderkey, id l_partkey, id l_suppkey, cast(1 + id % 7 AS int) l_linenumber, 1.0D l_quantity",
    }
    for name, sql in rows.items():
        spark.range({"nation": 25, "lineitem": 1000}.get(name, 400)).selectExpr(*sql.split(", ")).write.parquet(f"{tmp_path}/{name}.parquet")
    files, make = [], jobs.grade_batches

    def watched(*given):
        write = make(*given)

        def each(batch, batch_id):
            files.append(batch.select(F.input_file_name()).distinct().count())
            write(batch, batch_id)

        return each

    monkeypatch.setattr(jobs, "grade_batches", watched)
    found = QUERIES["stream_grade"](spark, str(tmp_path)).collect()
    assert len(files) == 3 and min(files) > 1
    assert found and sorted(found) == sorted(QUERIES["resolution"](spark, str(tmp_path)).collect())


def test_report_is_made_from_stored_states(spark, tmp_path, monkeypatch):
    """Counts and ids made from the logs anew, each with all shuffles kept, took many times the input's disk."""
    from patchloom.plans.catalog import streams

    rows = {
        "orders": "IF(id = 7, NULL, id % 390) o_orderkey, id % 390 o_custkey, 'O' o_orderstatus, 1.0D o_totalprice, timestamp'1995-01-01' o_orderdate, 'm' o_orderpriority",
        "customer": "IF(id = 9, NULL, id) c_custkey, 'c' c_name, CAST(id % 5 AS INT) c_nationkey, 1.0D c_acctbal, 's' c_mktsegment",
        "nation": "CAST(id AS INT) n_nationkey, 'n' n_name, 0 n_regionkey",
        "lineitem": "IF(id = 5, NULL, id % 300) l_orderkey, id l_partkey, id l_suppkey, CAST(1 + id % 7 AS INT) l_linenumber, IF(id % 40 = 3, 50.0D, 1.0D) l_quantity",
    }
    for name, sql in rows.items():
        spark.range({"nation": 25, "lineitem": 1000}.get(name, 400)).selectExpr(*re.split(r", (?=[^()]*(?:\(|$))", sql)).write.parquet(f"{tmp_path}/{name}.parquet")
    tidy, write, written = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", streams.writers.write_report, {}

    def watched(counts, ids, path):
        written.update(tidy=spark.conf.get(tidy), counts=counts, ids=ids, path=path)
        write(counts, ids, path)

    monkeypatch.setattr(streams.writers, "write_report", watched)
    before = spark.conf.get(tidy)
    found = sorted(map(tuple, QUERIES["report_sink"](spark, str(tmp_path)).collect()))
    assert found and found == sorted(map(tuple, QUERIES["run_report_ids"](spark, str(tmp_path)).collect()))
    assert spark.read.json(f"{written['path']}/counts").first().asDict() == QUERIES["run_report"](spark, str(tmp_path)).first().asDict()
    assert "Join" not in plan(written["counts"]) + plan(written["ids"])
    assert written["tidy"] == "true" and spark.conf.get(tidy) == before


def test_shuffles_of_a_pin_go_when_it_ends(spark):
    from patchloom.session import pin, tidy_shuffles

    def shuffles():
        folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f.name for d in folders for f in Path(d.getPath()).rglob("shuffle_*")}

    before = shuffles()
    with tidy_shuffles(spark):
        rows = pin(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before and rows.agg(F.sum("count")).first()[0] == 1000


def test_stored_predictions_join_by_sorting(spark):
    from patchloom.operators import grade
    from patchloom.session import pin

    data = spark.range(4).selectExpr("'i' || id instance_id")
    preds = pin(spark.range(3).selectExpr("'i' || id instance_id", "IF(id = 0, '', 'p') model_patch"))
    reports = pin(spark.range(2).selectExpr("'i' || id instance_id", "true resolved"))
    states = grade.run_states(data, preds, reports)
    assert "BroadcastHashJoin" not in plan(states)
    assert {r["instance_id"]: r["state"] for r in states.collect()} == {"i0": "empty_patch", "i1": "resolved", "i2": "error", "i3": "incomplete"}
