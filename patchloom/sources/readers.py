"""Readers with fixed schemas: instances, predictions, reports, logs, repository files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from patchloom.functions import text as tx
from patchloom.operators.diffs import is_test_path

INSTANCE = T.StructType([
    T.StructField(c, T.StringType())
    for c in (
        "repo", "instance_id", "base_commit", "patch", "test_patch", "problem_statement", "hints_text", "created_at",
        "version", "FAIL_TO_PASS", "PASS_TO_PASS", "environment_setup_commit",
    )
])
PREDICTION = T.StructType([
    T.StructField(c, T.StringType()) for c in ("instance_id", "model_name_or_path", "model_patch", "full_output")
])
BINARY_TEXT = "[BINARY DATA FILE]"

# <run>/<model>/<instance>/<file>
RUN_PATH = r"([^/]+)/([^/]+)/([^/]+)/[^/]+$"


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType, corrupt: str | None = None) -> DataFrame:
    """Rows of .jsonl / .jsonl.all (one object per line) or .json (whole file).

    ``corrupt`` names a column that receives unreadable lines.
    """
    name = path.rstrip("*")
    reader = spark.read.schema(schema if corrupt is None else T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())]))
    if corrupt:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
    if name.endswith(".json"):
        return reader.option("multiLine", "true").json(path)
    if name.endswith((".jsonl", ".jsonl.all")):
        return reader.json(path)
    raise ValueError(f"{path}: expected .json, .jsonl or .jsonl.all")


def read_instances(spark: SparkSession, path: str, split: str = "test", ids: list[str] | None = None) -> DataFrame:
    """Task instances from .json, .jsonl, .parquet or a folder with ``<split>.parquet``.

    Ids that the table lacks raise an error that names them.
    """
    if path.endswith((".json", ".jsonl", ".jsonl.all")):
        rows = read_json_rows(spark, path, INSTANCE)
    elif path.endswith(".parquet"):
        rows = spark.read.parquet(path)
    else:
        rows = spark.read.parquet(f"{path.rstrip('/')}/{split}.parquet")
    if not ids:
        return rows
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in sorted(set(ids))], "instance_id string"))
    missing = [r[0] for r in wanted.join(rows, "instance_id", "left_anti").collect()]  # at most the ids passed in
    if missing:
        raise ValueError(f"instance ids not found: {' '.join(sorted(missing))}")
    return rows.join(wanted, "instance_id", "left_semi")


def _seq(file: Column, block: Column, line: Column) -> Column:
    return F.struct(file.alias("file"), block.cast("long").alias("block"), line.cast("long").alias("line"))


def read_predictions(spark: SparkSession, path: str, instances: DataFrame | None = None) -> DataFrame:
    """Predictions with a ``seq`` that orders rows by file and line.

    ``gold`` takes the patches of the instances. A .json file holds a list, or an object
    whose values are the rows. A row without instance_id raises an error.
    """
    if path == "gold":
        return instances.select(
            "instance_id", F.lit("gold").alias("model_name_or_path"), F.col("patch").alias("model_patch"),
            F.lit(None).cast("string").alias("full_output"), _seq(F.lit(""), F.lit(0), F.lit(0)).alias("seq"),
        )
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
        body = tx.lstrip(F.col("value"))
        as_list = F.from_json("value", T.ArrayType(PREDICTION))
        as_map = F.map_values(F.from_json("value", T.MapType(T.StringType(), PREDICTION)))
        rows = whole.select("file", F.posexplode(F.when(body.startswith("["), as_list).otherwise(as_map)).alias("line", "r")).select(
            "r.*", _seq(F.col("file"), F.lit(0), F.col("line")).alias("seq"))
    elif path.endswith(".jsonl"):
        # one task reads a block of a file from its start, so the row id grows inside a block
        seq = _seq(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
        rows = spark.read.schema(PREDICTION).json(path).select("*", seq.alias("seq"))
    else:
        raise ValueError("predictions must be .json or .jsonl")
    if not rows.filter(F.col("instance_id").isNull()).isEmpty():
        raise ValueError("every prediction needs an instance_id")
    return rows


def _run_part(i: int) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), RUN_PATH, i)


def _run_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name)
        .text(root, wholetext=True)
        .select(
            _run_part(1).alias("run_id"), F.replace(_run_part(2), F.lit("__"), F.lit("/")).alias("model"),
            _run_part(3).alias("instance_id"), "value",
        )
    )


def read_logs(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, model, instance_id, log) of every test_output.txt below ``root``."""
    return _run_files(spark, root, "test_output.txt").withColumnRenamed("value", "log")


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, model, instance_id, resolved) of every report.json; null when empty, malformed or without its key."""
    schema = "map<string, struct<resolved: boolean>>"
    report = F.try_element_at(F.from_json("value", schema, {"mode": "PERMISSIVE"}), F.col("instance_id"))
    return _run_files(spark, root, "report.json").withColumn("resolved", report["resolved"]).drop("value")


def repo_texts(files: DataFrame, include_tests: bool = False) -> DataFrame:
    """Python files (repo, commit, path, binary content) as text; tests left out.

    Content that is not UTF-8 becomes a fixed phrase.
    """
    shown = files.filter(F.col("path").endswith(".py"))
    if not include_tests:
        shown = shown.filter(~is_test_path(F.col("path")))
    return shown.withColumn("content", F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit(BINARY_TEXT)))


def read_repo_files(spark: SparkSession, root: str, repo: str, commit: str, include_tests: bool = False) -> DataFrame:
    """(repo, commit, path, content) of the Python files below a checked-out folder."""
    base = "file:" + root.rstrip("/") + "/" if root.startswith("/") else root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(root)
    files = raw.select(
        F.lit(repo).alias("repo"), F.lit(commit).alias("commit"),
        F.substr(F.col("path"), F.lit(len(base) + 1)).alias("path"), "content",
    )
    return repo_texts(files, include_tests)


def version_files(files: DataFrame, paths: list[str]) -> DataFrame:
    """Files at the given paths."""
    return files.filter(F.col("path").isin(*paths))
