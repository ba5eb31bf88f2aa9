"""Product-quantizer codes of vectors, learned exactly over anchors-hierarchy metric trees.

Vectors become integers and are cut into parts; each part position has a codebook that is refined
by rounds of assignment and averaging. Each task packs its rows into chunks and builds one metric
tree per chunk and part position, once. A tree is made middle-out: about sqrt(n) anchors take points
from each other as far as the triangle inequality lets them, their balls are merged pair by pair up
to the root, and each anchor's points get a tree of their own in the same way. A ball caches the sum
and the number of its points.

In a round a ball inherits the codebook entries that may own points of it, and drops each entry
whose bisecting plane with the nearest one leaves the ball out. A ball with one entry left is
wholly owned: its cached sum and count go to that entry. Only leaves with several entries left
compare points. All distances that decide are exact integers; bounds keep a margin.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from patchloom.session import pin

PARTS, ENTRIES, ROUNDS = 4, 256, 4
CHUNK = 4096  # rows of one tree
LEAF = 128  # points of a ball that is not divided further
BOUND = 1 << 27  # larger components count as this; sums of squares then stay within 64 bits
_MARGIN = 1e-9


def _anchors(x: np.ndarray) -> list[np.ndarray]:
    """Points (row numbers) of about sqrt(n) anchors: the next one is the point farthest from its own."""
    n = len(x)
    owner = np.zeros(n, dtype=np.int64)
    pivots = [x[0]]
    distance = np.sqrt(((x - x[0]) ** 2).sum(1))
    while len(pivots) < isqrt(n - 1) + 1:
        far = int(distance.argmax())
        if distance[far] == 0:
            break
        new = x[far]
        apart = np.sqrt(((np.array(pivots) - new) ** 2).sum(1))
        near = np.flatnonzero(2 * distance >= apart[owner])  # the others can't be nearer to the new anchor
        d = np.sqrt(((x[near] - new) ** 2).sum(1))
        taken = d < distance[near]
        owner[near[taken]] = len(pivots)
        distance[near[taken]] = d[taken]
        owner[far], distance[far] = len(pivots), 0.0
        pivots.append(new)
    return [at for k in range(len(pivots)) if len(at := np.flatnonzero(owner == k))]


class Tree:
    """Balls over the rows of ``points`` (integers); ball 0 is the root, children come later."""

    FIELDS = {"order": np.int32, "begin": np.int32, "end": np.int32, "left": np.int32, "right": np.int32, "radius": np.float64, "sums": np.int64}

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        tree, x = cls(), points.astype(np.float64)
        balls: list[list] = []  # (first, one past the last, left, right, radius, sum)
        order: list[np.ndarray] = []
        placed = 0

        def ball(rows: np.ndarray) -> tuple[np.ndarray, float]:
            total = points[rows].sum(0)
            return total, float(np.sqrt(((x[rows] - total / len(rows)) ** 2).sum(1).max()))

        def shape(rows: np.ndarray):
            """Nested (rows, sum, radius, children) of a ball, middle-out."""
            total, radius = ball(rows)
            if len(rows) <= leaf or radius == 0:
                return rows, total, radius, None
            groups = _anchors(x[rows])
            if len(groups) < 2:
                return rows, total, radius, None
            parts = [shape(rows[g]) for g in groups]
            centre = np.array([p[1] / len(p[0]) for p in parts])
            reach = np.array([p[2] for p in parts])
            live = np.ones(len(parts), dtype=bool)
            cost = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2)) + reach[:, None] + reach[None]
            np.fill_diagonal(cost, np.inf)
            for _ in range(len(parts) - 1):  # the two balls with the smallest ball around both become one
                a, b = divmod(int(cost.argmin()), len(parts))
                both = np.concatenate([parts[a][0], parts[b][0]])
                parts[a] = (both, *ball(both), (parts[a], parts[b]))
                centre[a], reach[a], live[b] = parts[a][1] / len(both), parts[a][2], False
                cost[b], cost[:, b] = np.inf, np.inf
                row = np.where(live, np.sqrt(((centre - centre[a]) ** 2).sum(1)) + reach + reach[a], np.inf)
                row[a] = np.inf
                cost[a], cost[:, a] = row, row
            return parts[int(np.flatnonzero(live)[0])]

        todo = [(shape(np.arange(len(points))), -1, 0)] if len(points) else []
        while todo:  # children are visited left first, so the points of a ball lie side by side
            (rows, total, radius, children), parent, side = todo.pop()
            at = len(balls)
            if parent >= 0:
                balls[parent][side] = at
            balls.append([placed, placed + len(rows), -1, -1, radius, total])
            if children is None:
                order.append(rows)
                placed += len(rows)
            else:
                todo += [(children[1], at, 3), (children[0], at, 2)]
        tree.order = np.concatenate(order).astype(np.int32) if order else np.zeros(0, np.int32)
        for i, name in enumerate(("begin", "end", "left", "right", "radius")):
            setattr(tree, name, np.array([b[i] for b in balls], dtype=cls.FIELDS[name]))
        tree.sums = np.array([b[5] for b in balls], dtype=np.int64).reshape(len(balls), points.shape[1])
        return tree


class Codebook:
    """Integer ``entries`` of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.x = entries.astype(np.float64)
        self.apart = np.sqrt(np.maximum(0, (self.x**2).sum(1)[:, None] + (self.x**2).sum(1)[None] - 2 * self.x @ self.x.T)) if len(entries) else np.zeros((0, 0))
        self.apart *= 1 + 1e-7  # never too small, so that no entry is dropped wrongly
        self.apart += 1e-3 * (self.apart > 0)
        self.squares = (entries**2).sum(1)
        self.largest = int(np.abs(entries).max(initial=0))

    def nearest(self, points: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Of the entries ``some`` (ascending), the nearest of each point; the first of several."""
        high = max(self.largest, int(np.abs(points).max(initial=0)))
        if high * high * points.shape[1] < 1 << 50:  # doubles hold these sums exactly
            score = self.squares[some].astype(np.float64) - 2 * (points.astype(np.float64) @ self.x[some].T)
        else:
            score = self.squares[some] - 2 * (points @ self.entries[some].T)
        return some[score.argmin(1)]

    def owners(self, tree: Tree, points: np.ndarray, whole) -> None:
        """Call ``whole(ball, entry)`` for balls that one entry owns, ``whole(ball, entries)`` for compared leaves."""
        if not len(tree.begin):
            return
        todo = [(0, np.arange(len(self.entries)))]
        while todo:
            at, some = todo.pop()
            n = tree.end[at] - tree.begin[at]
            square = ((self.x[some] - tree.sums[at] / n) ** 2).sum(1)
            best = int(square.argmin())
            room = 2 * tree.radius[at] * self.apart[some[best], some]
            some = some[square - square[best] - room <= _MARGIN * (square + square[best] + room + 1)]
            if len(some) == 1:
                whole(at, int(some[0]))
            elif tree.left[at] < 0:
                whole(at, self.nearest(points[tree.order[tree.begin[at]:tree.end[at]]], some))
            else:
                todo += [(int(tree.right[at]), some), (int(tree.left[at]), some)]

    def add_to(self, sums: np.ndarray, counts: np.ndarray, tree: Tree, points: np.ndarray) -> None:
        """Add the points of a tree to the sums and counts of the entries that own them."""
        def whole(at: int, entry: int | np.ndarray) -> None:
            if isinstance(entry, int):
                sums[entry] += tree.sums[at]
                counts[entry] += tree.end[at] - tree.begin[at]
            else:
                np.add.at(sums, entry, points[tree.order[tree.begin[at]:tree.end[at]]])
                np.add.at(counts, entry, 1)
        self.owners(tree, points, whole)

    def codes(self, tree: Tree, points: np.ndarray) -> np.ndarray:
        """Index of the nearest entry of each point."""
        out = np.zeros(len(points), dtype=np.int64)

        def whole(at: int, entry: int | np.ndarray) -> None:
            out[tree.order[tree.begin[at]:tree.end[at]]] = entry

        self.owners(tree, points, whole)
        return out


def _plant(width: int, parts: int):
    """Chunks of rows (row struct, v array) with their trees, all parts one after another in each field."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in stream:
            while batch.num_rows:
                room = CHUNK - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == CHUNK:
                    yield chunk(held)
                    held = []
        if held:
            yield chunk(held)

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        rows, points = table.column("row").combine_chunks(), np.asarray(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, parts * width)
        trees = [Tree.build(points[:, p * width:(p + 1) * width].astype(np.int64)) for p in range(parts)]
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        fields = {name: one(pa.array(np.concatenate([getattr(t, name).ravel() for t in trees]))) for name in Tree.FIELDS}
        balls = one(pa.array([len(t.begin) for t in trees], pa.int32()))
        return pa.RecordBatch.from_arrays([one(rows), one(pa.array(points.ravel())), balls, *fields.values()], names=["rows", "points", "balls", *fields])

    return run


def _chunks(batch: pa.RecordBatch, width: int, parts: int) -> Iterator[tuple[pa.Array, np.ndarray, list[Tree]]]:
    for i in range(batch.num_rows):
        value = lambda c: batch.column(c)[i].values  # noqa: B023, E731
        rows = value("rows")
        points = np.asarray(value("points")).reshape(len(rows), parts * width).astype(np.int64)
        balls = np.asarray(value("balls"))
        trees = [Tree() for _ in range(parts)]
        for name in Tree.FIELDS:
            flat = np.asarray(value(name))
            sizes = [len(rows)] * parts if name == "order" else balls * (width if name == "sums" else 1)
            for tree, piece in zip(trees, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                setattr(tree, name, piece.reshape(-1, width) if name == "sums" else piece)
        yield rows, points, trees


def _sums(books: list[np.ndarray], width: int):
    """Sums and counts of every entry over all chunks of a task."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [Codebook(b) for b in books]
        totals = [(np.zeros_like(b), np.zeros(len(b), dtype=np.int64)) for b in books]
        for batch in stream:
            for _, points, trees in _chunks(batch, width, len(parts)):
                for p, (book, (sums, counts), tree) in enumerate(zip(parts, totals, trees, strict=True)):
                    book.add_to(sums, counts, tree, points[:, p * width:(p + 1) * width])
        for p, (sums, counts) in enumerate(totals):
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), p, dtype=np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))],
                names=["part", "entry", "n", "sums"])
    return run


def _code(books: list[np.ndarray], width: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [Codebook(b) for b in books]
        for batch in stream:
            for rows, points, trees in _chunks(batch, width, len(parts)):
                codes, error = [], np.zeros(len(points), dtype=np.int64)
                for p, (book, tree) in enumerate(zip(parts, trees, strict=True)):
                    part = points[:, p * width:(p + 1) * width]
                    codes.append(book.codes(tree, part))
                    error += ((part - book.entries[codes[-1]]) ** 2).sum(1)
                text = ["".join(f"{c:02x}" for c in code) for code in zip(*(c.tolist() for c in codes), strict=True)]
                yield pa.RecordBatch.from_arrays([rows, pa.array(text), pa.array(error)], names=["row", "code", "error"])
    return run


def integer_vectors(vector: str, scale: int):
    """(whole vector or null, is it fit): floor(scale * x) of each component, held within BOUND."""
    x = F.col(vector).cast("array<double>")
    fit = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.transform(x, lambda c: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(c * scale))).cast("int")), fit


def plant(rows: DataFrame, carry: list[str], vector: str = "embedding", scale: int = 1024, parts: int = PARTS, entries: int = ENTRIES,
          key: str = "vec_id") -> tuple[DataFrame, list[np.ndarray], int]:
    """(pinned chunks with trees, first codebooks, width of a part) of the rows with fit vectors."""
    whole, fit = integer_vectors(vector, scale)
    kept = rows.filter(fit).select(F.struct(*carry).alias("row"), F.col(key).alias("key"), whole.alias("v"))
    longest = kept.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0
    width = max(1, -(-longest // parts))
    padded = kept.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(width * parts) - F.size("v"))))
    first = [r["v"] for r in padded.select("key", "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).collect()]
    start = np.array(first, dtype=np.int64).reshape(len(first), parts * width)
    fields = ", ".join(f"{n} array<{ {np.int32: 'int', np.int64: 'bigint', np.float64: 'double'}[t] }>" for n, t in Tree.FIELDS.items())
    kind = padded.schema["row"].dataType.simpleString()
    trees = pin(padded.select("row", "v").mapInArrow(_plant(width, parts), f"rows array<{kind}>, points array<int>, balls array<int>, {fields}"))
    return trees, [start[:, p * width:(p + 1) * width] for p in range(parts)], width


def refine(trees: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """One round: assign all points, then move each used entry to the floor of its mean.

    What comes to the driver is one sum per entry and component, whatever the number of rows.
    """
    partial = trees.mapInArrow(_sums(books, width), "part int, entry int, n long, sums array<long>")
    each = partial.select("part", "entry", "n", F.posexplode("sums").alias("at", "x"))
    means = each.groupBy("part", "entry", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    out = [b.copy() for b in books]
    for r in means.collect():
        out[r["part"]][r["entry"], r["at"]] = r["x"] // r["n"]
    return out


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(
    rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding",
    scale: int = 1024, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of each row with a fit vector.

    Codebooks start as the parts of the first ``entries`` rows by (key, vector), null keys last; with
    fewer rows they are smaller. Rows whose vector is null or holds a null or a component that isn't
    finite are dropped. Shorter vectors are padded with zeros to the longest, and that to a multiple
    of ``parts``; an empty vector is all zeros. Components beyond ``BOUND`` count as it. Repeated rows
    each count and each come back; null labels are one group. No rows give no rows.
    """
    trees, books, width = plant(rows, [F.col(key).alias("key"), F.col(label).alias("label")], vector, scale, parts, entries, key)
    for _ in range(rounds):
        books = refine(trees, books, width)
    kind = trees.schema["rows"].dataType.elementType.simpleString()
    coded = pin(trees.mapInArrow(_code(books, width), f"row {kind}, code string, error long").select(F.col("row.key").alias("key"), F.col("row.label").alias("label"), "code", "error"))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select(
        F.col("key").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
