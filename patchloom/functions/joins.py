"""A join for skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

def salted_join(
    big: DataFrame,
    small_side: DataFrame,
    keys: list[str],
    spread_by: list[str],
    rows_per_slice: int = 500_000,
) -> DataFrame:
    """Inner join where a key of ``big`` may hold any share of the rows.

    Each key gets as many slices as its row count asks for; its rows are spread
    over the slices by a hash of ``spread_by`` and the matching rows of the other
    side are repeated once per slice. Cold keys have one slice, so nothing is
    repeated for them.
    """
    hot = (
        big.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_slice)
        .select(*keys, F.ceil(F.col("_n") / rows_per_slice).cast("int").alias("_slices"))
    )
    # at most (rows of big / rows_per_slice) keys; Spark broadcasts them by their real size
    left = (
        big.join(hot, keys, "left")
        .withColumn("_slice", F.pmod(F.xxhash64(*spread_by), F.coalesce("_slices", F.lit(1))).cast("int"))
        .drop("_slices")
    )
    right = (
        small_side.join(hot, keys, "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)))
        .drop("_slices")
    )
    return left.join(right, [*keys, "_slice"]).drop("_slice")
