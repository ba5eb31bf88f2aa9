"""Incremental jobs. A restarted query goes on from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from patchloom.operators import grade
from patchloom.operators.ingest import failure_runs
from patchloom.operators.logs.dispatch import parser_of
from patchloom.session import pin


def run_available(stream: DataFrame, checkpoint: str, path: str | None = None, each=None, mode: str = "append") -> None:
    """Process what is there and stop: into parquet files at ``path``, or batch-wise by ``each``."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query: StreamingQuery = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", path).start()
    query.awaitTermination()


def _earlier(spark, path: str, schema, batch_id: int) -> DataFrame:
    """What batches before this one wrote below ``path``; nothing at the first batch."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*").filter(F.col("batch") < batch_id).drop("batch")


def keep_first(path: str, key: str = "instance_id"):
    """Batch writer that keeps the first row of each key over all batches.

    What was kept so far is the table itself, so the query holds no state that grows. Of rows
    of one key in a batch any one stays. A repeated batch replaces its own folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = T.StructType([batch.schema[key], T.StructField("batch", T.IntegerType())])
        seen = _earlier(batch.sparkSession, path, kept, batch_id).select(key)
        batch.dropDuplicates([key]).join(seen, key, "left_anti").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def first_predictions(stream: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """The first prediction of each instance within ``delay`` of event time; the state is bounded by it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["instance_id"])


def tally(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Running counts; the state holds one row per key."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def keep_latest_tally(path: str):
    """Batch writer for complete-mode tallies: each batch is a folder, the highest one counts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def grade_batches(gold: DataFrame, path: str, parser: str | None = None):
    """Batch writer that grades new logs (model, instance_id, repo, log).

    A batch replaces its own folder, so a repeated batch leaves no second copy. ``gold`` is read
    for each batch, and joining its runs leaves only the rows of its instances; no list of them is
    broadcast. Logs of unknown formats are not graded.
    """
    keys = ["model", "instance_id"]

    def write(batch: DataFrame, batch_id: int) -> None:
        logs = batch if parser else batch.withColumn("parser", parser_of(F.col("repo"), F.col("instance_id")))
        runs, status = grade.grade_logs(logs, keys, parser)
        rates = grade.grade_rates(grade.grade_tests(runs.filter("gradable"), gold, status, keys), keys)
        out = rates.select(*keys, "f2p_rate", "p2p_rate", grade.resolution(F.col("f2p_rate"), F.col("p2p_rate")).alias("resolution"))
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


_OPEN = "run long, first long, length long, successes long"


def watch_failures(path: str, order: list[str], limit: int = 5):
    """Batch writer that finds runs of failures (rows with ``ok``); batches must arrive in event order.

    A batch writes the runs that ended in it to ``runs`` and the one it ends in to ``open``, with
    the number of successes so far. The next batch goes on from there, so a run across batches
    is one run, and run numbers are those of a single pass. One row reaches the driver.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(_OPEN).parquet(f"{path}/open/batch={batch_id - 1}").first() if batch_id else None
        successes = before["successes"] if before else 0
        found = failure_runs(batch, order, limit).select((F.col("run") + successes).alias("run"), F.col("first").cast("long"), "length")
        if before and before["length"]:
            carried = spark.createDataFrame([(before["run"], before["first"], before["length"])], "run long, first long, length long")
            found = found.unionByName(carried).groupBy("run").agg(F.min("first").alias("first"), F.sum("length").alias("length"))
        found = pin(found.withColumn("aborts", F.col("length") >= limit))
        total = successes + batch.filter("ok").count()
        found.filter(F.col("run") < total).write.mode("overwrite").parquet(f"{path}/runs/batch={batch_id}")
        last = found.filter(F.col("run") == total).first()
        row = (total, last["first"] if last else None, last["length"] if last else 0, total)
        spark.createDataFrame([row], _OPEN).write.mode("overwrite").parquet(f"{path}/open/batch={batch_id}")

    return write


def failures_so_far(spark, path: str, limit: int = 5) -> DataFrame:
    """(run, first, length, aborts): ended runs of all batches and the one that the last batch ended in."""
    ended = spark.read.schema("run long, first long, length long, aborts boolean, batch int").parquet(f"{path}/runs").drop("batch")
    state = spark.read.schema(_OPEN + ", batch int").parquet(f"{path}/open")
    last = state.agg(F.max_by(F.struct("run", "first", "length"), "batch").alias("s")).select("s.*").filter("length > 0")
    return ended.unionByName(last.withColumn("aborts", F.col("length") >= limit))
