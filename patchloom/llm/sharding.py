"""Jump consistent hashing: a stable key and a shard count give the shard, without a ring table.

When one shard is appended, a key either stays or moves into the new shard; 1/(n + 1) of the
keys move. Everything here is column arithmetic; no row needs another row, except for the slot
numbers, which take one range sort of narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from patchloom.functions.order import with_row_index

#: Fixed values of the generator that the method prescribes.
MULTIPLIER = 2862933555777941757
_M_HIGH, _M_LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_WORD = 0xFFFFFFFF


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) 32-bit words of ``key * MULTIPLIER + 1`` modulo 2**64.

    Products are split so that none leaves the range of a signed long, which ANSI mode forbids.
    """
    upper = F.shiftright(low, 16) * F.lit(_M_LOW)
    sum_low = (low.bitwiseAND(F.lit(0xFFFF))) * F.lit(_M_LOW) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    crossed = (
        high.bitwiseAND(F.lit(0xFFFF)) * F.lit(_M_LOW)
        + F.shiftleft((F.shiftright(high, 16) * F.lit(_M_LOW)).bitwiseAND(F.lit(0xFFFF)), 16)
    ).bitwiseAND(F.lit(_WORD))
    sum_high = F.shiftright(sum_low, 32) + F.shiftright(upper, 16) + (low * F.lit(_M_HIGH)).bitwiseAND(F.lit(_WORD)) + crossed
    return sum_high.bitwiseAND(F.lit(_WORD)), sum_low.bitwiseAND(F.lit(_WORD))


def jump_hash(key: Column, n: int) -> Column:
    """Struct (shard, grown): the shard of the long ``key`` among n shards and among n + 1.

    A null key counts as 0, a negative one as its unsigned 64-bit value. The candidate shard
    grows by at least one in each step, so n + 1 steps are enough for every key.
    """
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(_WORD)).alias("low"),
        F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"), F.lit(0).cast("long").alias("next"),
    )

    def move(s: Column, _: Column) -> Column:
        high, low = _step(s["high"], s["low"])
        jump = (s["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))
        moved = F.struct(
            high.alias("high"), low.alias("low"),
            F.when(s["next"] < n, s["next"]).otherwise(s["shard"]).alias("shard"), s["next"].alias("grown"),
            F.floor(jump).cast("long").alias("next"),
        )
        return F.when(s["next"] > n, s).otherwise(moved)

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(n)), start, move,
        lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")),
    )


def shard_rows(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for each row.

    Size is the UTF-8 bytes of the text plus 8; a null text counts as empty. Slots number the
    rows of a shard from 0 by key (nulls first), size and checksum; equal rows take neighbouring
    slots. Rows with equal keys share a shard, wherever they come from.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key), (F.octet_length(plain) + 8).cast("long").alias("size"), F.crc32(plain.cast("binary")).alias("text_crc32"),
        jump_hash(F.col(key), n).alias("_at"),
    ).select(key, "size", "text_crc32", F.col("_at.shard").alias("shard"), F.col("_at.grown").alias("grown_shard"))
    numbered = with_row_index(rows, ["shard", key, "size", "text_crc32"], "_index")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard
    offsets = numbered.groupBy("shard").agg(F.count(F.lit(1)).alias("_n")).select(
        "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return numbered.join(F.broadcast(offsets), "shard").select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_index") - F.col("_before")).cast("long").alias("slot"), "grown_shard")
