"""Order MinHash fingerprints: which k-mers a text has, how often, and in which order.

Every k-mer of code points gets its occurrence number (the first "aba" is not the second) and one
hash. The hashes lie on a circle; slot b of the fingerprint takes the L occurrences that come
first from point b / SLOTS of the circle on, puts them back into text order and hashes the tuple.
Moving a passage changes the order within tuples, so the share of equal slots follows edit
distance, not only the sets of k-mers. All sizes of text go by the same rule; long texts only
skip sorting hashes that can't be among the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from patchloom.llm.words import mix
from patchloom.session import pin

K, L, SLOTS = 5, 2, 64  # code points a k-mer, occurrences a slot, slots (a power of two)
_ARC = 64 - (SLOTS - 1).bit_length()
_BASE = np.uint64(0x9E3779B97F4A7C15)
_OCCURRENCE = np.uint64(0xC2B2AE3D27D4EB4F)
_STARTS = np.arange(SLOTS, dtype=np.uint64) << np.uint64(_ARC)


def _kmers(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    n = max(1, len(codes) - K + 1)
    out = codes[:n].copy()
    for j in range(1, min(K, len(codes))):
        out = out * _BASE + codes[j:j + n]
    return mix(out)


def _numbered(kmers: np.ndarray) -> np.ndarray:
    """Hash of each k-mer together with its occurrence number."""
    n = len(kmers)
    bits = np.uint64(max(1, n.bit_length()))
    packed = np.sort((kmers >> bits << bits) | np.arange(n, dtype=np.uint64))
    value = packed >> bits
    again = value[1:] == value[:-1]
    if not again.any():
        return mix(kmers)
    at = np.arange(n)
    first = at.copy()
    first[1:][again] = 0
    number = at - np.maximum.accumulate(first)
    later = np.flatnonzero(number)
    out = kmers.copy()
    out[(packed[later] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] += number[later].astype(np.uint64) * _OCCURRENCE
    return mix(out)


def signature(text: str) -> np.ndarray:
    """16 bits for each slot; an empty text has no slots."""
    if not text:
        return np.zeros(0, dtype=np.uint16)
    kmers = _kmers(text)
    order = _numbered(kmers)
    n = len(order)
    near = np.arange(n)
    if n > 40 * SLOTS:  # enough of those that follow each start closely, or else all
        close = np.flatnonzero((order & np.uint64((1 << _ARC) - 1)) < np.uint64((1 << _ARC) // (n // SLOTS) * 16))
        if np.bincount((order[close] >> np.uint64(_ARC)).astype(np.int64), minlength=SLOTS).min() >= L:
            near = close
    near = near[np.argsort(order[near], kind="stable")]
    first = np.searchsorted(order[near], _STARTS)
    take = min(L, n)
    chosen = np.sort(near[(first[:, None] + np.arange(take)) % len(near)], axis=1)  # back in text order
    out = np.zeros(SLOTS, dtype=np.uint64)
    for j in range(take):
        out = mix(out * _BASE + kmers[chosen[:, j]])
    return (out >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots; two empty texts are alike, an empty and another one not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def _hex(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first code points of ``following``."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def _row(text: str, own: np.ndarray, following: str, next_one: np.ndarray) -> tuple:
    changed = edited(text, following)
    its = signature(changed)
    return (len(text), hashlib.sha256(changed.encode()).hexdigest(), _hex(own), _hex(its), likeness(own, its), likeness(own, next_one))


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [f.split(" ")[0] for f in _OUT.split(", ")]


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint (hex, 4 digits a slot; empty for null and empty texts). Map-only."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([_hex(signature(v.as_py() or "")) for v in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit("")).schema)


def edit_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: fingerprints of its text and of its edited text, and likenesses.

    The next document is the one with the next lower key; null keys come last, equal keys are
    ordered by a hash of the text, and the first document follows the last. Texts move once, in
    the range sort by key; a task holds two of them. The first and last text of each sorted
    partition, two rows a partition, are paired in a second small step.
    """
    plain = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    ordered = plain.sort(F.col(key).desc_nulls_last(), F.xxhash64("_text"))
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = last = None  # (key, text, signature)
        rows: list[tuple] = []
        schema = None
        for batch in batches:
            schema = pa.schema([batch.schema.field(0).with_name(key), *(pa.field(n, k) for n, k in zip(_NAMES, _KINDS, strict=True)),
                                pa.field("_edge", pa.int32()), pa.field("_part", pa.int32()), pa.field("_text", pa.string())])
            for k, v in zip(batch.column(0), batch.column(1), strict=True):
                now = (k.as_py(), v.as_py(), signature(v.as_py()))
                if last is None:
                    first = now
                else:
                    rows.append((last[0], *_row(last[1], last[2], now[1], now[2]), 0, part, None))
                last = now
            yield _table(rows, schema)
            rows = []
        if first is not None:
            yield _table([(x[0], *[None] * len(_NAMES), edge, part, x[1]) for edge, x in ((1, first), (2, last))], schema)

    made = pin(ordered.mapInArrow(run, f"`{key}` {key_type}, {_OUT}, _edge int, _part int, _text string"))
    edges = made.filter("_edge > 0")
    # one row per sorted partition
    parts = edges.filter("_edge = 1").select("_part")
    order = Window.orderBy("_part")
    follows = parts.select("_part", F.coalesce(F.lead("_part").over(order), F.min("_part").over(Window.partitionBy())).alias("_next"))
    pairs = edges.filter("_edge = 2").select(key, "_part", "_text").join(follows, "_part").join(
        edges.filter("_edge = 1").select(F.col("_part").alias("_next"), F.col("_text").alias("_following")), "_next").select(key, "_text", "_following")

    def join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), *(pa.field(n, k) for n, k in zip(_NAMES, _KINDS, strict=True))])
            yield _table([(k, *_row(a, signature(a), b, signature(b))) for k, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)], schema)

    at_edges = pairs.mapInArrow(join_edges, f"`{key}` {key_type}, {_OUT}")
    return made.filter("_edge = 0").select(key, *_NAMES).unionByName(at_edges)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
