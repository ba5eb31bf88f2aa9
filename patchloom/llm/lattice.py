"""Near-duplicate embeddings by E8 lattice hashing.

Unit vectors are projected at random to BLOCKS times eight dimensions, and each eight are decoded
to the nearest point of the E8 lattice; the points are the vector's cell. TABLES projections give
as many cells. A vector also visits the neighbouring cells whose borders are nearest, so that a
close pair meets in a table unless both lie across a corner. Vectors that visit a cell are tied
to the smallest one that lives there, one tie each; what ties connect is a candidate group, and
cosines are verified between all members of a group, block by block. No list of pairs is made:
a block gives sums of links and one row for each vector in a connected part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from patchloom.llm.components import components
from patchloom.llm.words import mix
from patchloom.session import pin

TABLES, BLOCKS, PROBES = 10, 2, 8
SCALE = 2.2  # lattice units for a distance of 1 between unit vectors; larger means smaller cells
LEAST_BLOCK, MOST_BLOCK, EVEN_BLOCKS = 64, 4096, 16  # rows of a block of a group, see _block_count
_SEED = 8


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8, which are the steps to the neighbouring cells."""
    rows = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            rows.append(v)
    rows += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(rows)


ROOTS = _roots()
_FACTORS = mix(np.arange(1, 8 * BLOCKS + 1, dtype=np.uint64)) | np.uint64(1)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum: the worst rounded one turns if the sum is odd."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(1)
    row = np.arange(len(x))
    near[row, worst] += np.where(near.sum(1) % 2 != 0, np.where(off[row, worst] >= 0, 1.0, -1.0), 0.0)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8, the union of D8 and D8 moved by one half, for each row of eight."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


def _hashed(points: np.ndarray, block: int) -> np.ndarray:
    twice = np.rint(points * 2).astype(np.int64).view(np.uint64)
    return (twice * _FACTORS[8 * block:8 * block + 8]).sum(1, dtype=np.uint64)


_STEPS = np.concatenate([_hashed(ROOTS, b) for b in range(BLOCKS)])


def cells(unit: np.ndarray, group: np.ndarray, table: int) -> np.ndarray:
    """Cells of one table: a row for each vector, first its own cell and then PROBES neighbours."""
    dim = unit.shape[1]
    projection = np.random.default_rng([_SEED, dim, table]).normal(size=(dim, 8 * BLOCKS)) * (SCALE / np.sqrt(8))
    at = unit @ projection
    own = mix(group.view(np.uint64) + np.uint64(table))
    gaps = []
    for b in range(BLOCKS):
        part = at[:, 8 * b:8 * b + 8]
        point = decode_e8(part)
        own = own + _hashed(point, b)
        gaps.append(1.0 - (part - point) @ ROOTS.T)  # twice the distance to each border, in steps
    gaps = np.concatenate(gaps, axis=1)
    nearest = np.argpartition(gaps, PROBES, axis=1)[:, :PROBES]
    return mix(np.concatenate([own[:, None], own[:, None] + _STEPS[nearest]], axis=1))


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def _visit(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, id, own) of vectors (id, g, dim, embedding)."""
    for batch in stream:
        dims = np.asarray(batch.column(2))
        for dim in np.unique(dims):
            rows = batch.filter(pa.array(dims == dim))
            for at in range(0, rows.num_rows, 2048):
                part = rows.slice(at, 2048)
                x = _matrix(part.column(3))
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                ids, group = (np.asarray(part.column(i)) for i in (0, 1))
                for table in range(TABLES):
                    found = cells(unit, group, table).view(np.int64)
                    first = np.zeros(found.shape, dtype=bool)
                    first[:, 0] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.ravel()), pa.array(np.repeat(ids, found.shape[1])), pa.array(first.ravel())], names=["cell", "id", "own"])


def _connected(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest position (left first, then right) that each row and each column of ``near`` reaches."""
    n, m = near.shape
    left, right = np.arange(n), np.arange(n, n + m)
    while True:
        to_left = np.minimum(left, np.where(near, right[None, :], n + m).min(1, initial=n + m))
        to_right = np.minimum(right, np.where(near, to_left[:, None], n + m).min(0, initial=n + m))
        if (to_left == left).all() and (to_right == right).all():
            return left, right
        left, right = to_left, to_right


def _compare(least: float):
    """Rows (id, links, root) of one pair of blocks of a group: weighted links, and a member of the same part."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        out = []
        for _, same in rows.groupby(["g", "dim"], sort=False):
            x = np.stack(same["embedding"].to_numpy()).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            ids, weight, block = same["id"].to_numpy(), same["n"].to_numpy(), same["block"].to_numpy()
            left = np.flatnonzero(block == i)
            right = left if i == j else np.flatnonzero(block == j)
            near = x[left] @ x[right].T >= least
            if i == j:
                np.fill_diagonal(near, True)  # the two sides of a vector are one
            reach_left, reach_right = _connected(near)
            if i == j:
                np.fill_diagonal(near, False)
            places = np.concatenate([ids[left], ids[right]])
            out.append(pd.DataFrame({"id": ids[left], "links": near @ weight[right], "root": places[reach_left]}))
            if i != j:
                out.append(pd.DataFrame({"id": ids[right], "links": near.T @ weight[left], "root": places[reach_right]}))
        found = pd.concat(out)
        return found[found["links"] > 0].astype({"id": "int64", "links": "int64", "root": "int64"})
    return run


def _block_count(size: Column) -> Column:
    """Up to EVEN_BLOCKS blocks of LEAST_BLOCK rows, so that a large group fills many tasks; then larger ones."""
    return F.greatest(F.least(F.ceil(size / LEAST_BLOCK), F.lit(EVEN_BLOCKS)), F.ceil(size / MOST_BLOCK)).cast("int")


def is_usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """(key, n_links, component_id, kept) for each row.

    Rows with equal labels (not null) and a cosine of at least ``least`` are linked. Equal vectors
    are one class; each row counts the others' rows. Unusable vectors, and those without a label,
    are linked with nothing. The component's id is the smallest key that links reach; null keys
    count as larger than every key. ``kept`` marks rows whose key is the id.
    """
    usable = is_usable(F.col(vector)) & F.col(label).isNotNull()
    rows = vectors.select(F.col(key).alias("_key"), F.col(vector).alias("embedding"), F.xxhash64(label).alias("g"), F.size(vector).alias("dim"),
                          F.xxhash64(vector).alias("e1"), F.hash(vector).alias("e2"), usable.alias("usable"))
    rows = pin(rows)
    name = ["g", "dim", "e1", "e2"]
    classes = pin(rows.filter("usable").groupBy(*name).agg(F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")).withColumn("id", F.monotonically_increasing_id()))
    visits = pin(classes.select("id", "g", "dim", "embedding").mapInArrow(_visit, "cell long, id long, own boolean"))
    homes = visits.groupBy("cell").agg(F.min(F.when(F.col("own"), F.col("id"))).alias("head"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 AND head IS NOT NULL")
    ties = visits.join(homes, "cell").filter("id <> head").select("id", "head").distinct()
    members = pin(components(ties, "id", "head").join(classes, F.col("node") == F.col("id")))
    sizes = members.groupBy("component").agg(_block_count(F.count(F.lit(1))).alias("blocks"))
    placed = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = placed.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "g", "dim", "block", "n", "embedding")
    found = pin(dealt.groupBy("component", "i", "j").applyInPandas(_compare(least), "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(found.filter("id <> root"), "id", "root")
    of_class = classes.select(*name, "id", "n").join(links, "id", "left").join(reached, F.col("id") == F.col("node"), "left").select(
        *name, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("_component"))
    marked = rows.filter("usable").select("_key", *name).join(of_class, name)
    least_key = pin(marked.groupBy("_component").agg(F.min("_key").alias("component_id")))
    linked = marked.join(least_key, "_component").select(F.col("_key").alias(key), "n_links", "component_id")
    alone = rows.filter("NOT usable").select(F.col("_key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
