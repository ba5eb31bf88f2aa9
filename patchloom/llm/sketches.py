"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function orders all shingles; a document's sketch is the k smallest of its hashes. Two
sets with Jaccard similarity of at least the threshold share most of their sketches, so that, in
any common order of the values, each must have a shared value among the first few
(k - shared + 1). Values are ordered by how many sketches hold them, rarest first, and only these
few go into inverted lists; a passage that very many documents hold comes last and is not
listed. What a list proposes is filtered by the estimate from the union of the two sketches and
verified by the exact Jaccard similarity of the full sets.

Documents with equal sets are one class from the start. A list ties each member to its smallest
member, one row each; what ties connect is a candidate group. All members of a group are compared
with each other inside tasks, block by block, first by sketches and then by full sets, and a block
gives one row for each member of a linked part. So a group of thousands of copies makes no list
of pairs, and no pair that a list holds goes untested.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from patchloom.llm.components import components, forest
from patchloom.llm.words import Words, batches, mix
from patchloom.session import pin

K = 48  # values of a sketch
LEAST_BLOCK, MOST_BLOCK, EVEN_BLOCKS = 64, 2048, 16  # rows of a block of a group, see _block_count
_SURE = 5  # standard deviations of sketch overlap that candidates may fall short by
_SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words of each text, A-Z lower-cased.

    A text with fewer words has one, of all its words; a text without words has none.
    """
    parsed = Words(texts, lower=True)
    runs = parsed.runs(words).view(np.int64)
    for lo, hi in zip(parsed.first[:-1].tolist(), parsed.first[1:].tolist(), strict=True):
        if hi - lo >= words:
            yield np.unique(runs[lo:hi - words + 1])
        elif hi > lo:
            whole = np.array([hi - lo], dtype=np.uint64)
            for j in range(lo, hi):
                whole = mix(whole * _SALTS[0] ^ parsed.hashes[j:j + 1])
            yield whole.view(np.int64)
        else:
            yield np.zeros(0, dtype=np.int64)


def _digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    h = values.view(np.uint64)
    return tuple(int(np.add.reduce(mix(h ^ s)).view(np.int64)) for s in _SALTS)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, dtype=np.int64), *parts])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat))


def _described(rows: DataFrame, text: str, words: int, k: int | None) -> DataFrame:
    """Replace ``text``, the last column, by n, h1, h2 and ``values``: the k smallest hashes, or all."""
    names = [c for c in rows.columns if c != text]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = (v.as_buffer().to_pybytes() if v.is_valid else None for v in batch.column(len(names)))
            done = 0
            for _, part in batches(texts):
                sets = list(shingle_sets(part, words))
                digests = [_digest(s) for s in sets]
                made = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)), _lists([s[:k] for s in sets])]
                own = batch.slice(done, len(part))
                done += len(part)
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], *made], names=[*names, "n", "h1", "h2", "values"])

    schema = rows.select(*names).withColumns({"n": F.lit(0).cast("long"), "h1": F.lit(0).cast("long"), "h2": F.lit(0).cast("long"), "values": F.array().cast("array<long>")}).schema
    return rows.select(*names, text).mapInArrow(run, schema)


def least_overlap(n: Column, percent: int, k: int = K) -> Column:
    """Values that sketches of two linked sets share at least, as far as one set's size tells."""
    p = percent / 100
    usual = math.floor(k * p - _SURE * math.sqrt(k * p * (1 - p)))
    return F.least(F.lit(max(1, usual)), F.ceil(n * percent / 100)).cast("int")


def _same_part(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest position (rows first, then columns) that each row and each column of ``near`` reaches."""
    rows, columns = np.nonzero(near)
    n = near.shape[0] + near.shape[1]
    part = np.arange(n)
    if len(rows):
        nodes, roots = forest(rows, columns + near.shape[0])
        part[nodes] = roots
    return part[: near.shape[0]], part[near.shape[0]:]


def _shared(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Number of common values of each set on the left and each on the right."""
    lv, rv = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(lv, rv)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    for at in range(0, len(common), columns):
        part = common[at:at + columns]
        sides = []
        for values, own, n in ((lv, owner[0], len(left)), (rv, owner[1], len(right))):
            place = np.searchsorted(part, values)
            hit = (place < len(part)) & (part[np.minimum(place, len(part) - 1)] == values)
            m = np.zeros((n, len(part)), dtype=np.float32)
            m[own[hit], place[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _likely(left: list[np.ndarray], right: list[np.ndarray], k: int, percent: int) -> np.ndarray:
    """Pairs whose similarity, estimated from the union of both sketches, may reach the threshold.

    Up to the smaller of the two largest values both sketches hold all that their sets hold.
    """
    shared = _shared(left, right)
    ends = [np.array([s[-1] if len(s) == k else np.iinfo(np.int64).max for s in side]) for side in (left, right)]
    upto_left = np.stack([np.searchsorted(s, np.minimum(e, ends[1]), side="right") for s, e in zip(left, ends[0], strict=True)])
    upto_right = np.stack([np.searchsorted(s, np.minimum(e, ends[0]), side="right") for s, e in zip(right, ends[1], strict=True)]).T
    union = upto_left + upto_right - shared
    p = percent / 100
    return shared >= p * union - _SURE * np.sqrt(p * (1 - p) * union)


def _compare(percent: int, k: int):
    """Rows (id, root) of linked members from rows (key of the block pair, same, block, id, values), sorted by key.

    ``values`` are the full sets in sorted order, so their first ``k`` are the sketches.
    """
    def linked(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        first = min(r[1] for r in rows)
        left = [r for r in rows if r[1] == first]
        right = left if rows[0][0] else [r for r in rows if r[1] != first]
        none = np.zeros(0, dtype=np.int64)
        if not right:
            return none, none
        sets = [[r[3] for r in side] for side in (left, right)]
        near = _likely(*([s[:k] for s in side] for side in sets), k, percent)
        if left is right:
            np.fill_diagonal(near, False)
        if near.any():
            at = near.any(1), near.any(0)
            some = [[s for s, use in zip(side, used, strict=True) if use] for side, used in zip(sets, at, strict=True)]
            common = _shared(*some)
            sizes = [np.array([len(s) for s in side], dtype=np.float64) for side in some]
            exact = common * 100.0 >= (sizes[0][:, None] + sizes[1][None, :] - common) * percent
            near[np.ix_(*at)] &= exact
        if left is right:
            np.fill_diagonal(near, True)  # the two sides of a set are one
        ids = np.array([r[2] for r in left] + [r[2] for r in right], dtype=np.int64)
        roots = ids[np.concatenate(_same_part(near))]
        moved = ids != roots
        return ids[moved], roots[moved]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            columns = [np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in zip(*found, strict=True)] or [np.zeros(0, dtype=np.int64)] * 2
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "root"])

        rows: list[tuple] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        now = None
        for batch in stream:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            blocks, ids, values = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)
            for key, block, one, value in zip(keys, blocks, ids, values, strict=True):
                if key != now:
                    if rows:
                        found.append(linked(rows))
                    rows, now = [], key
                rows.append((key[1] == key[2], block, one, value.values.to_numpy()))
            yield table(found)
            found = []
        if rows:
            yield table([linked(rows)])
    return run


def _block_count(size: Column) -> Column:
    """Up to EVEN_BLOCKS blocks of LEAST_BLOCK rows, so that a large group fills many tasks; then larger ones."""
    return F.greatest(F.least(F.ceil(size / LEAST_BLOCK), F.lit(EVEN_BLOCKS)), F.ceil(size / MOST_BLOCK)).cast("int")


def _placed(docs: DataFrame, key: str, text: str, words: int, percent: int, k: int) -> DataFrame:
    """(_key, _k, _t, n, _component) of each row; the component is a class id, null without words."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), *_pointer(key, text), body.cast("binary").alias("_text"))
    described = pin(_described(rows, "_text", words, k))
    grouped = described.filter("n > 0").groupBy("h1", "h2").agg(
        F.first("n").alias("n"), F.first("values").alias("values"), F.min(F.struct("_t", "_k")).alias("_from"))
    classes = pin(grouped.withColumn("id", F.monotonically_increasing_id()))

    def sets_of(ids: DataFrame) -> DataFrame:
        """(id, values): full sets of some classes, made again from one text of each."""
        wanted = classes.join(ids, "id").select("id", F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("_from._t").alias("_t"), F.col("_from._k").alias("_k"))
        found = rows.select("_t", "_k", "_text").join(wanted, ["_t", "_k"]).select("id", "_h1", "_h2", "_text")
        full = _described(found, "_text", words, None).filter("h1 = _h1 AND h2 = _h2")
        return pin(full.dropDuplicates(["id"]).select("id", "values"))

    reached = components(_links(classes, sets_of, percent, k), "id", "root")
    of_class = classes.select("h1", "h2", "id").join(reached, F.col("id") == F.col("node"), "left").select(
        "h1", "h2", F.coalesce("component", "id").alias("_component"))
    return pin(described.select("_key", "_k", "_t", "n", "h1", "h2").join(of_class, ["h1", "h2"], "left").select(
        "_key", "_k", "_t", "n", F.when(F.col("n") > 0, F.col("_component")).alias("_component")))


def _pointer(key: str, text: str) -> list[Column]:
    """Two hashes that find a row again by its key and text."""
    return [F.xxhash64(key).alias("_k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_t")]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 85, k: int = K) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``docs``.

    Documents are linked where 100 * |A and B| >= percent * |A or B| for their shingle sets. The
    component's id is the smallest key that links reach; nulls count as larger than every key,
    so a component of null keys has a null id. ``kept`` marks rows whose key is the id. Rows with
    no words are linked with nothing, not even with each other; null and empty texts are such.
    Repeated rows are rows of their own.
    """
    placed = _placed(docs, key, text, words, percent, k)
    least = pin(placed.filter("_component IS NOT NULL").groupBy("_component").agg(F.min("_key").alias("_least")))
    out = placed.join(least, "_component", "left").select(
        F.col("_key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("_component").isNull(), F.col("_key")).otherwise(F.col("_least")).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """``docs`` with one row of each component, that with the smallest key; all columns as they are.

    Null keys go last; of rows with equal key and text that with the least hash of its columns
    stays. Rows without words all stay.
    """
    placed = _placed(docs, key, text, words, percent, k).filter("_component IS NOT NULL")
    best = placed.groupBy("_component").agg(F.min(F.struct(F.col("_key").isNull(), "_key", "_t", "_k")).alias("_best"))
    chosen = pin(best.select("_best._k", "_best._t"))
    worded = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    packed = docs.select(F.struct(*docs.columns).alias("_row"), *_pointer(key, text), F.xxhash64(*hashed).alias("_all"), worded.alias("_worded"))
    # an aggregate, because copies of one row are then dropped before they are moved
    stay = packed.filter("_worded").join(chosen, ["_k", "_t"], "left_semi").groupBy("_k", "_t").agg(F.min_by("_row", "_all").alias("_row"))
    return stay.select("_row.*").unionByName(packed.filter("NOT _worded").select("_row.*"))


def _links(classes: DataFrame, sets_of, percent: int, k: int) -> DataFrame:
    """Links (id, root) between classes that join all that are linked, and no others."""
    held = classes.select("id", F.explode("values").alias("v"))
    shared = pin(held.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    sizes = classes.select("id", "n", F.size("values").alias("_s"))
    ranked = held.join(shared, "v").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("_values"))  # at most k
    indexed = F.col("_s") - least_overlap(F.col("n"), percent, k) + 1  # values to list, counting those that no other sketch holds
    listed = F.greatest(F.lit(0), indexed - (F.col("_s") - F.size("_values")))
    lists = pin(ranked.join(sizes, "id").select("id", F.explode(F.slice(F.col("_values.v"), F.lit(1), listed)).alias("v")))
    heads = lists.groupBy("v").agg(F.min("id").alias("_head"))
    ties = lists.join(heads, "v").filter("id <> _head").select("id", "_head").distinct()
    grouped = components(ties, "id", "_head")
    full = sets_of(grouped.select(F.col("node").alias("id"))).join(grouped, F.col("id") == F.col("node"))
    blocks = grouped.groupBy("component").agg(_block_count(F.count(F.lit(1))).alias("blocks"))
    placed = full.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = placed.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "values")
    dealt = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return pin(dealt.mapInArrow(_compare(percent, k), "id long, root long"))
