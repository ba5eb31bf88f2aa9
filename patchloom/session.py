"""Session settings and the durable working folder used to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

_FOLDERS: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder of the session.

    The folder named by ``spark.checkpoint.dir`` always wins. Only a local
    session without one gets a temporary folder; a cluster session must name a
    shared folder, because a machine-local one is lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="patchloom-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return sc.getCheckpointDir()


def _drop_pinned(spark: SparkSession, folder: str) -> None:
    """Delete what a session has pinned, while it can still reach the store."""
    if spark.sparkContext._jsc is None:  # stopped already
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pinned_folder(spark: SparkSession) -> str:
    """Folder of the tables that this session pins; it goes when the process ends in order."""
    application = spark.sparkContext.applicationId
    if application not in _FOLDERS:
        _FOLDERS[application] = f"{ensure_checkpoint_dir(spark)}/pinned/{application}-{uuid.uuid4().hex}"
        atexit.register(_drop_pinned, spark, _FOLDERS[application])
    return _FOLDERS[application]


def pin(df: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` once below the checkpoint folder and go on from that table; ``options`` go to the writer.

    Later stages read only the columns they need, know the size of the table, and
    survive the loss of any executor without repeating what made it.
    """
    spark = df.sparkSession
    path = path or f"{pinned_folder(spark)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a write or an action go when it ends.

    Otherwise they stay until the driver happens to collect its garbage, so a job of several
    pins holds the shuffles of all of them at once.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def refuse_unknown(ids: DataFrame, what: str) -> None:
    """Raise an error when there are ``ids`` (instance_id); it names the table that lists them all."""
    path = f"{ensure_checkpoint_dir(ids.sparkSession)}/unknown/{uuid.uuid4().hex}"
    row = pin(ids.select("instance_id").distinct(), path).agg(F.count(F.lit(1)).alias("n"), F.min("instance_id").alias("first")).first()
    if row["n"]:
        raise ValueError(f"{row['n']} {what}, the first is {row['first']}; all of them are in {path}")


def local_session(cores: int | str = 8, app: str = "patchloom", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
