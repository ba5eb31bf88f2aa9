"""Global order without a single-partition window.

``Window.orderBy`` without ``partitionBy`` moves a whole table into one task, and
a window over one hot key does the same for that key. The helpers here sort by
range, number rows inside each sorted partition, and shift every partition by the
totals of those before it. The only data that meets in one place is one row per
(partition, key).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from patchloom.session import pin

_SHIFT = 33  # monotonically_increasing_id: partition number above bit 33


def _sorted_parts(df: DataFrame, order: list) -> DataFrame:
    """Range-sort, keep (part, pos) of every row, and make the copy durable.

    The copy is what fixes the partition borders: totals and rows are then read
    from the same files, also after a task is retried.
    """
    mono = df.sort(*order).withColumn("_m", F.monotonically_increasing_id())
    return pin(mono.select("*", F.shiftright("_m", _SHIFT).alias("_part"))).withColumn(
        "_pos", F.col("_m") - F.shiftleft("_part", _SHIFT)
    ).drop("_m")


def with_row_index(df: DataFrame, order: list, name: str = "row_index", total: str | None = None) -> DataFrame:
    """0-based position of each row in the total order ``order``."""
    parts = _sorted_parts(df, order)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per sort partition, never more than spark.sql.shuffle.partitions
    w = Window.orderBy("_part")
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )
    out = parts.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_pos") + F.col("_off"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_part", "_pos", "_off", "_total")


def with_running_sum(df: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the key (the row itself excluded).

    Works for a key that fills many partitions: rows are summed inside their
    partition, and (partition, key) totals carry the rest.
    """
    parts = _sorted_parts(df, [*keys, *order])
    totals = parts.groupBy(*keys, "_part").agg(F.sum(value).alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_part", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_part"]])
    kept = [F.col(f"l.{c}") for c in local.columns if c not in ("_part", "_pos", "_local")]
    return (
        local.alias("l")
        .join(carried.alias("r"), on)
        .select(*kept, (F.col("l._local") + F.col("r._carry")).alias(name))
    )


def chunk_of(index: Column, total: Column, n: int) -> Column:
    """Number (0-based) of the contiguous chunk when ``total`` rows form ``n`` chunks
    whose sizes differ by at most one, larger chunks first."""
    small = F.floor(total / F.lit(n))
    rest = total % F.lit(n)
    edge = rest * (small + 1)
    return (
        F.when(index < edge, F.floor(index / (small + 1)))
        .otherwise(rest + F.floor((index - edge) / F.greatest(small, F.lit(1))))
        .cast("long")
    )
