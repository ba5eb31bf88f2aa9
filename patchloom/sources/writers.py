"""Sinks: JSON lines, report tables, merged shards, and output names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None, append: bool = True) -> None:
    """One JSON object per line; appended, so that an interrupted collection can go on."""
    writer = df.write.mode("append" if append else "overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_report(counts: DataFrame, ids: DataFrame, path: str) -> None:
    """The run report: one row of counts, and the id lists as rows sorted within each list.

    The lists may hold every instance of a large run, so they are written as a table
    partitioned by list instead of one JSON object.
    """
    counts.write.mode("overwrite").json(f"{path}/counts")
    ids.repartitionByRange("list_name", "instance_id").sortWithinPartitions("list_name", "instance_id").write.mode(
        "overwrite").partitionBy("list_name").json(f"{path}/ids")


def report_name(model: str, run_id: str) -> str:
    return f"{model.replace('/', '__')}.{run_id}"


def merge_shards(spark: SparkSession, path: str, schema: T.StructType, expected: int) -> DataFrame:
    """All shards below ``path`` as one table; a lost or doubled row raises an error."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    n = rows.count()
    if n != expected:
        raise ValueError(f"{path}: {n} rows in the shards, {expected} expected")
    return rows


def dataset_name(
    dataset: str, style: str, source: str, k: int | None = None, max_len: int | None = None, tokenizer: str | None = None
) -> str:
    """Name of a prompt dataset, from the choices that made it."""
    parts = [dataset.replace("/", "__"), style, f"fs-{source}"]
    if k is not None:
        parts.append(f"k-{k}")
    if max_len is not None:
        parts.append(f"mcc-{max_len}-{tokenizer}")
    return "__".join(parts)


def output_name(model: str, dataset: str, split: str, shard: int | None = None, shards: int | None = None) -> str:
    """Stem of a prediction file."""
    stem = "__".join([model.replace("/", "__"), dataset.replace("/", "__"), split])
    return stem if shard is None or shards is None else f"{stem}__shard-{shard}-of-{shards}"


def order_for_files(df: DataFrame, length: str, key: str) -> DataFrame:
    """Short rows first across and inside output files."""
    return df.repartitionByRange(F.col(length), F.col(key)).sortWithinPartitions(length, key)
