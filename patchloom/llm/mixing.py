"""Mix sources to target sizes with whole copies of documents, by pivotal dependent rounding.

Each document of a source should be taken ``rate`` times, the source's target over its size. The
whole part is certain. The fractional parts are rounded together: two documents meet, and size
moves from one to the other at random, without changing what either expects, until one of them
is taken a whole number of times; the other meets the next. So the size that is taken stays
within one document of the target for each source, and each document keeps its chance.

Documents meet inside groups of bounded size; what is left of each group, one document, meets
the others' in the next level of a reduction tree, one small job per level.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from patchloom.functions.order import with_row_index
from patchloom.session import pin

WORD = r"[^\x20\x09-\x0D]+"
GROUP_ROWS = 512  # documents that meet in one group of the first level
FAN_IN = 64  # groups whose rests meet in one group of the next
_WHOLE = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], total: float, most: float, source: str = "source") -> DataFrame:
    """(source, n, source_size, target) of each source; a null source is one of its own, the last.

    Weights go round the sources in code point order. Together they share ``total`` times all
    sizes; a target stops at ``most`` times its source's size and the excess is shared among the
    others by weight until none is above. That level is found by one small aggregate a round.
    """
    sums = sizes.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    ranked = with_row_index(sums, [F.col(source).asc_nulls_last()], "_rank")
    given = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = pin(ranked.withColumn("_weight", given).withColumn("_cap", F.col("source_size") * float(most)).drop("_rank"))
    wanted = (ranked.agg(F.sum("source_size")).first()[0] or 0) * float(total)
    level, stopped = 0.0, -1
    while True:
        above = F.col("_cap") < level * F.col("_weight")
        row = ranked.agg(
            F.count(F.when(above, 1)).alias("stopped"), F.sum(F.when(above, F.col("_cap").cast("decimal(38,3)"))).alias("full"),
            F.sum(F.when(~above, F.col("_weight").cast("decimal(38,6)"))).alias("weight")).first()
        if row["stopped"] == stopped or not row["weight"]:
            break
        stopped = row["stopped"]
        level = (wanted - float(row["full"] or 0)) / float(row["weight"])
    target = F.when(F.col("_cap") < level * F.col("_weight"), F.col("_cap")).otherwise(level * F.col("_weight"))
    return ranked.select(source, "n", "source_size", target.alias("target"))


def pivot(size: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round ``share`` (0 to 1) so that the sum of size * share is kept; one share may stay between.

    Each meeting makes one of two documents whole and keeps what both expect.
    """
    share = share.copy()
    draws = rng.random(len(share))
    open_ = -1
    for j in np.flatnonzero((share > _WHOLE) & (share < 1 - _WHOLE)).tolist():
        if open_ < 0:
            open_ = j
            continue
        i = open_
        a, b = size[i], size[j]
        have_i, have_j = a * share[i], b * share[j]
        up, down = min(a - have_i, have_j), min(have_i, b - have_j)  # what i can gain, what it can lose
        moved = up if draws[j] * (up + down) < down else -down
        share[i], share[j] = (have_i + moved) / a, (have_j - moved) / b
        free = [k for k in (i, j) if _WHOLE < share[k] < 1 - _WHOLE]
        open_ = free[0] if free else -1
    settled = (share <= _WHOLE) | (share >= 1 - _WHOLE)
    return np.where(settled, np.round(share), share)


def take_copies(docs: DataFrame, targets: DataFrame, key: Sequence[str], source: str = "source", seed: int = 20) -> DataFrame:
    """``docs`` (key columns, source, size) with source_size, target and ``copies``.

    Documents without size are not taken. The same rows give the same copies in any order; equal
    rows are units of their own.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    names = [*key, source, "size"]
    rows = docs.select(*names).alias("d").join(
        F.broadcast(targets).alias("t") if targets.count() <= 10_000 else targets.alias("t"), F.col(f"d.{source}").eqNullSafe(F.col(f"t.{source}"))
    ).select(*(F.col(f"d.{c}").alias(c) for c in names), "source_size", "target", F.when(F.col("size") > 0, rate).otherwise(0.0).alias("_rate"),
             F.ceil(F.col("n") / GROUP_ROWS).cast("long").alias("_groups"))
    rows = rows.withColumn("_base", F.floor("_rate").cast("long")).withColumn("_share", F.col("_rate") - F.col("_base")).withColumn(
        "_order", F.xxhash64(F.lit(seed), *key)).withColumn("_group", F.pmod(F.xxhash64(F.lit(seed + 1), *key), "_groups")).drop("_rate", "_groups")
    groups = targets.agg(F.max(F.ceil(F.col("n") / GROUP_ROWS))).first()[0] or 1
    done = None
    level = 0
    while True:
        last = groups <= 1
        rounded = pin(_round_groups(rows, source, seed, level, last))
        settled = rounded.filter("_share = 0 OR _share = 1")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        rows = rounded.filter("_share > 0 AND _share < 1").withColumn("_group", F.floor(F.col("_group") / FAN_IN).cast("long"))
        groups = -(-groups // FAN_IN)
        level += 1
    return done.select(*names, "source_size", "target", (F.col("_base") + F.col("_share").cast("long")).alias("copies"))


def _round_groups(rows: DataFrame, source: str, seed: int, level: int, last: bool) -> DataFrame:
    columns = rows.columns

    def run(group: pd.DataFrame) -> pd.DataFrame:
        # large documents first, so that what is left open at the end is a small one
        group = group.sort_values(["size", "_order"], ascending=[False, True], kind="stable")
        name = group[source].iloc[0]
        rng = np.random.default_rng([seed, level, int(group["_group"].iloc[0]), zlib.crc32(str(name).encode()), int(name is None)])
        share = pivot(group["size"].to_numpy(np.float64), group["_share"].to_numpy(np.float64), rng)
        if last:  # at most one is left: its chance decides
            share = np.where((share > 0) & (share < 1), (rng.random() < share).astype(float), share)
        group["_share"] = share
        return group[columns]

    return rows.groupBy(source, "_group").applyInPandas(run, rows.schema)


def mix(docs: DataFrame, weights: Sequence[float], total: float, most: float, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 20) -> DataFrame:
    """(key, size, source_size, target, taken) for each document; size counts words, a null text has none.

    ``taken`` counts the words of all copies. No document is taken more than ``ceil(most)`` times.
    Empty tables give no rows.
    """
    sizes = pin(docs.select(key, source, word_count(F.col(text)).alias("size")))
    targets = pin(source_targets(sizes, weights, total, most, source))
    taken = take_copies(sizes, targets, [key], source, seed)
    return taken.select(key, "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_rows(docs: DataFrame, weights: Sequence[float], total: float, most: float, text: str = "text", source: str = "source", seed: int = 20) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; all columns as they are.

    Rows that are equal in all columns count as one document of their joint size, so they are
    taken equally often. Rows without words are not taken.
    """
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(*hashed).alias("_p"), F.hash(*hashed).alias("_q"))
    units = docs.select(F.xxhash64(*hashed).alias("_p"), F.hash(*hashed).alias("_q"), F.col(source).alias("_source"), word_count(F.col(text)).alias("size"))
    sizes = pin(units.groupBy("_p", "_q", "_source").agg(F.sum("size").alias("size")))
    targets = pin(source_targets(sizes, weights, total, most, "_source"))
    copies = pin(take_copies(sizes, targets, ["_p", "_q"], "_source", seed).filter("copies > 0").select("_p", "_q", "copies"))
    joined = packed.join(copies, ["_p", "_q"])
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
