"""Connected components of links between long ids, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from patchloom.session import pin

_FLUSH = 4_000_000  # links that a task contracts together


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest id that the given links reach from each)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        for side in (root[left], root[right]):  # the roots of both ends hook to the smaller one
            np.minimum.at(new, side, low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _contract(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nodes, roots = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])

    for batch in stream:
        if batch.num_rows:
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
            size += batch.num_rows
        if size > _FLUSH:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``links``: the smallest id that links reach.

    Each task contracts the links of its own split to trees. A node whose trees differ links
    their roots; those links, fewer each time, are contracted in the same way, and the labels
    come back by joins. Loops and repeated links do no harm; links with a null end are left out.
    Without links there are no rows.
    """
    ends = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    trees = pin(pin(ends).mapInArrow(_contract, "node long, root long"))
    nodes = pin(trees.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("_other")))
    torn = nodes.filter("root <> _other")
    if torn.isEmpty():
        return nodes.select("node", F.col("root").alias("component"))
    between = trees.join(torn.select("node", F.col("root").alias("_least")), "node").filter("root <> _least").select(
        F.col("root").alias("a"), F.col("_least").alias("b")).distinct()
    above = components(between).select(F.col("node").alias("root"), "component")
    return pin(nodes.join(above, "root", "left").select("node", F.coalesce("component", "root").alias("component")))
