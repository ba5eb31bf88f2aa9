"""Hard negatives by exact integer scores: Strassen products of tiles, then mergeable heaps.

Rows are dealt to bands by a hash, anchors go to every band. A task holds one band and streams the
anchors past it in tiles. Scores of a tile come from Strassen's recursion over int64 matrices; of
each tile only what can still enter a heap is looked at. Heaps hold the best (score, id) of an
anchor, or of an anchor and one of its positives; those of all bands are merged behind a shuffle
by anchor, which carries at most k rows a band and heap.

Two passes: the first compares anchors with rows of their own label and finds the positives, the
second compares them with all others inside the windows that the positives' scores set.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from patchloom.session import pin

LEAF = 32  # a product with a side of at most so many is multiplied directly
TILE = 256, 1024  # anchors and rows of one product
BAND = 4096, 65536  # rows that a task holds at once; between the two, twice the root of all rows
_LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices, by seven half-size products; odd sides are padded with zeros.

    Integer sums are exact in any order; beyond 64 bits all of them wrap alike.
    """
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), dtype=np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """The ``k`` best (score, id) of each of ``count`` heaps: high scores first, then small ids."""

    def __init__(self, count: int, k: int):
        self.count, self.k = count, k
        self.heap, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.floor = np.full(count, _LEAST)  # a lower score can't enter

    def push(self, heap: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Offer entries; pushing those of another set of heaps merges the two."""
        if not len(heap):
            return
        heap, score, ids = (np.concatenate(x) for x in ((self.heap, heap), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, heap))  # ~x = -x - 1 turns the order without overflow
        heap = heap[order]
        rank = np.arange(len(heap)) - np.searchsorted(heap, heap)
        keep = rank < self.k
        self.heap, self.score, self.id = heap[keep], score[order][keep], ids[order][keep]
        last = rank[keep] == self.k - 1
        self.floor[self.heap[last]] = self.score[last]

    def offer(self, heap: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """Push the entries of a tile that ``fits`` marks; its row r belongs to ``heap[r]``, its column c to ``ids[c]``."""
        fits &= scores >= self.floor[heap][:, None]
        if fits.shape[1] > 4 * self.k and np.count_nonzero(fits) > 4 * self.k * len(heap):  # most can't be among the k best of the tile
            at = fits.shape[1] - self.k
            fits &= scores >= np.partition(np.where(fits, scores, _LEAST), at, axis=1)[:, at, None]
        row, column = np.nonzero(fits)
        self.push(heap[row], scores[row, column], ids[column])


def _blocks(stream: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[dict, dict]]:
    """(rows of a band, a tile of anchors); rows come sorted by (band, is_anchor)."""
    now, held, rows = None, [], {}
    for batch in stream:
        band, anchor = (np.asarray(batch.column(i)) for i in ("band", "is_anchor"))
        edges = np.flatnonzero((band[1:] != band[:-1]) | (anchor[1:] != anchor[:-1])) + 1
        for lo, hi in zip([0, *edges], [*edges, len(band)], strict=True):
            if lo == hi:
                continue
            if band[lo] != now:
                now, held, rows = band[lo], [], {}
            part = batch.slice(lo, hi - lo)
            if not anchor[lo]:
                held.append({"id": np.asarray(part.column("id")), "label": np.asarray(part.column("label")), "v": np.asarray(part.column("v").flatten()).reshape(hi - lo, dim)})
                continue
            if held:
                rows = {c: np.concatenate([x[c] for x in held]) for c in held[0]}
                held = []
            for at in range(0, hi - lo if rows else 0, TILE[0]):
                tile = part.slice(at, TILE[0])
                yield rows, {
                    "a": np.asarray(tile.column("a")), "id": np.asarray(tile.column("id")), "label": np.asarray(tile.column("label")),
                    "v": np.asarray(tile.column("v").flatten()).reshape(tile.num_rows, dim), "found": tile.column("found"),
                }


def _products(rows: dict, anchors: np.ndarray, lo: int, hi: int) -> Iterator[tuple[slice, np.ndarray]]:
    for at in range(lo, hi, TILE[1]):
        part = slice(at, min(hi, at + TILE[1]))
        yield part, strassen(anchors, rows["v"][part].T)


def _positives(dim: int, k: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, tile in _blocks(stream, dim):
            heaps = Heaps(len(tile["a"]), k)
            for label in np.unique(tile["label"]):  # rows and anchors are sorted by label
                lo, hi = (int(np.searchsorted(rows["label"], label, side=side)) for side in ("left", "right"))
                own = np.flatnonzero(tile["label"] == label)
                for part, scores in _products(rows, tile["v"][own], lo, hi):
                    heaps.offer(own, scores, rows["id"][part] != tile["id"][own][:, None], rows["id"][part])
            yield pa.RecordBatch.from_arrays([pa.array(tile["a"][heaps.heap]), pa.array(heaps.score), pa.array(heaps.id)], names=["a", "score", "id"])
    return run


def _windows(dim: int, k: int, least: int, most: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, tile in _blocks(stream, dim):
            found = tile["found"].to_pylist()
            width = max(len(f) for f in found)
            heaps = Heaps(len(found) * width, k)
            sets = []  # per rank of a positive: anchors that have one, and the ends of their windows
            for j in range(width):
                own = np.flatnonzero([len(f) > j for f in found])
                scores = [found[r][j]["score"] for r in own]
                ends = [-(-least * s // 100) for s in scores], [most * s // 100 for s in scores]
                sets.append((own, *(np.clip(np.array(e, dtype=object), _LEAST, -_LEAST - 1).astype(np.int64)[:, None] for e in ends)))
            for part, scores in _products(rows, tile["v"], 0, len(rows["id"])):
                other = rows["label"][part] != tile["label"][:, None]
                for j, (own, lo, hi) in enumerate(sets):
                    mine = scores[own]
                    heaps.offer(own * width + j, mine, (mine >= lo) & (mine <= hi) & other[own], rows["id"][part])
            row, rank = np.divmod(heaps.heap, width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tile["a"][row]), pa.array(rank.astype(np.int32)), pa.array(tile["id"][row]), pa.array([found[r][j]["id"] for r, j in zip(row, rank, strict=True)], pa.int64()),
                 pa.array([found[r][j]["score"] for r, j in zip(row, rank, strict=True)], pa.int64()), pa.array(heaps.score), pa.array(heaps.id)],
                names=["a", "j", "anchor_id", "positive_id", "positive_score", "score", "id"])
    return run


def _merge(keys: int, k: int):
    """Merge heaps whose entries come sorted by the first ``keys`` columns; adds the rank, from 1."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # entries of the last heap, which may go on
        for batch in stream:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            if not table.num_rows:
                continue
            new = np.zeros(table.num_rows, dtype=bool)
            for i in range(keys):
                key = np.asarray(table.column(i))
                new[1:] |= key[1:] != key[:-1]
            whole, rest = made(table, new)
            yield whole
        if rest is not None:
            yield ranked(rest, np.arange(1, rest.num_rows + 1))

    def best(table: pa.Table, heap: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        heaps = Heaps(int(heap[-1]) + 1, k)
        score, ids = (np.asarray(table.column(c)) for c in ("score", "id"))
        heaps.push(heap, score, ids)
        first = np.searchsorted(heap, heaps.heap)
        rank = np.arange(len(heaps.heap)) - np.searchsorted(heaps.heap, heaps.heap)
        kept = table.take(pa.array(first))  # the columns of a heap besides score and id are the same in all its rows
        for name, values in (("score", heaps.score), ("id", heaps.id)):
            kept = kept.set_column(kept.schema.get_field_index(name), name, pa.array(values))
        return kept, rank + 1, heaps.heap

    def made(table: pa.Table, new: np.ndarray) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        kept, rank, heap = best(table, np.cumsum(new))
        cut = int(np.searchsorted(heap, heap[-1]))
        return ranked(kept.slice(0, cut), rank[:cut]), kept.slice(cut).combine_chunks().to_batches()[0]

    def ranked(rows: pa.Table | pa.RecordBatch, rank: np.ndarray) -> pa.RecordBatch:
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array(rank.astype(np.int32))], names=[*rows.schema.names, "rank"])

    return run


def _merged(partial: DataFrame, keys: list[str], k: int) -> DataFrame:
    schema = f"{', '.join(f'{n} {t}' for n, t in partial.dtypes)}, rank int"
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge(len(keys), k), schema)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, key: str = "vec_id", label: str | Column = "label", vector: str = "embedding",
    scale: int = 256, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ranks from 1.

    A component x counts as floor(scale * x), a score is the inner product with the anchor. Positives are
    an anchor's best other rows of its label, negatives the best rows of other labels whose score is
    ``least`` to ``most`` percent of the positive's; ties go to smaller ids.

    Rows with a null id, label, vector or component, or a component that isn't finite, take no part.
    Shorter vectors count as padded with zeros. Rows that agree in id, label and integer vector count once;
    of an id with several labels or vectors each is a row, and none is "other" to its namesakes. Floors
    beyond 64 bits stop there, scores wrap at 64 bits. No anchors or no rows give no rows.
    """
    label = F.col(label) if isinstance(label, str) else label
    x = F.col(vector).cast("array<double>")
    clean = rows.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("v"), is_anchor.alias("is_anchor")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    whole = clean.select("id", "label", F.transform("v", lambda c: F.floor(c * scale)).alias("v"), F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"))
    table = pin(whole.groupBy("id", "label", "v").agg(F.max("is_anchor").alias("is_anchor")))  # copies are combined before the shuffle
    sizes = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim = sizes["dim"] or 0
    per_band = min(BAND[1], max(BAND[0], 2 * isqrt(sizes["n"])))
    bands = max(1, -(-sizes["n"] // per_band))
    padded = table.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))))
    dealt = padded.select(
        F.pmod(F.xxhash64("id", "label", "v"), F.lit(bands)).cast("int").alias("band"), F.lit(False).alias("is_anchor"), F.lit(None).cast("long").alias("a"),
        "id", "label", "v", F.lit(None).cast("array<struct<id:long,score:long>>").alias("found"))
    anchors = pin(padded.filter("is_anchor").select(F.monotonically_increasing_id().alias("a"), "id", "label", "v"))

    def side_by_side(asking: DataFrame) -> DataFrame:
        everywhere = asking.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))).withColumn("is_anchor", F.lit(True)).select(dealt.columns)
        return dealt.unionByName(everywhere).repartition("band").sortWithinPartitions("band", "is_anchor", "label", "id")

    met = side_by_side(anchors.withColumn("found", F.lit(None).cast("array<struct<id:long,score:long>>")))
    best = _merged(met.mapInArrow(_positives(dim, positives), "a long, score long, id long"), ["a"], positives)
    found = best.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))  # at most ``positives`` of them
    asking = pin(anchors.join(found.select("a", F.transform("found", lambda f: F.struct(f["id"].alias("id"), f["score"].alias("score"))).alias("found")), "a"))
    partial = side_by_side(asking).mapInArrow(
        _windows(dim, negatives, least, most), "a long, j int, anchor_id long, positive_id long, positive_score long, score long, id long")
    return _merged(partial, ["a", "j"], negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
