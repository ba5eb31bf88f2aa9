"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is split into pre-tokens by a pattern. Tier one: a minimal perfect hash finds pre-tokens
that are vocabulary entries as a whole; the entry found is compared with the pre-token, so a
stranger is never taken for a member. Tier two: other pre-tokens are merged with a heap of
(rank, place) over a linked list of their bytes, which takes O(n log n) for a run of n bytes.

The tables are bounded by the vocabulary, built on the driver once and broadcast. Encoding and
decoding are map-only. Special tokens are never made: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

#: Pre-tokens of which a task remembers the ids; beyond it, it forgets and starts again.
REMEMBERED = 600_000
_KEYS_PER_BUCKET = 3


class PerfectHash:
    """Minimal perfect hash by displacement: n keys fill n slots.

    Keys that share a bucket share one seed, found by trial, largest buckets first; a key alone
    in its bucket takes a slot that is left, noted as ``-1 - slot``.
    """

    def __init__(self, keys: list[bytes]):
        self.n = max(1, len(keys))
        self.n_buckets = max(1, len(keys) // _KEYS_PER_BUCKET)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) != len(keys):
            raise ValueError("keys repeat")
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        for i, h in enumerate(hashes):
            buckets[h % self.n_buckets].append(i)
        self.seeds = [0] * self.n_buckets
        self.keys = [-1] * self.n
        for b in sorted((b for b in range(self.n_buckets) if len(buckets[b]) > 1), key=lambda b: -len(buckets[b])):
            own, seed = buckets[b], 0
            while True:
                places = {self._place(hashes[i], seed): i for i in own}
                if len(places) == len(own) and all(self.keys[p] < 0 for p in places):
                    break
                seed += 1
            for p, i in places.items():
                self.keys[p] = i
            self.seeds[b] = seed
        free = (p for p in range(self.n) if self.keys[p] < 0)
        for b, p in zip((b for b in range(self.n_buckets) if len(buckets[b]) == 1), list(free)):
            self.keys[p] = buckets[b][0]
            self.seeds[b] = -1 - p

    def _place(self, h: int, seed: int) -> int:
        x = ((h ^ (seed * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x >> 20) % self.n

    def find(self, key: bytes) -> int:
        """Index of the only key that ``key`` can be; -1 if there is none."""
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[h % self.n_buckets]
        return self.keys[-1 - seed if seed < 0 else self._place(h, seed)]


class _Ids(dict):
    """Ids of the pre-tokens met so far; others are encoded when they are first asked for."""

    def __init__(self, encode_piece):
        self.encode_piece = encode_piece

    def __missing__(self, piece: str) -> list[int]:
        made = self[piece] = self.encode_piece(piece.encode())
        return made


def _classes(kind: str) -> str:
    """Ranges, for a character class, of the characters up to U+FFFF that ``kind`` matches."""
    ranges: list[list[int]] = []
    test = regex.compile(kind)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and test.match(chr(c)):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges)


def plain_pattern(pattern: str) -> str:
    """``pattern`` with its Unicode classes written out, for the quicker ``re`` module.

    It holds for texts without characters beyond U+FFFF.
    """
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        ranges = _classes(kind)
        if kind == r"\s":
            pattern = pattern.replace(r"\S", f"[^{ranges}]")
        inside, out = False, ""
        at = 0
        while at < len(pattern):
            if pattern.startswith(kind, at):
                out += ranges if inside else f"[{ranges}]"
                at += len(kind)
                continue
            if pattern[at] == "\\":
                out += pattern[at:at + 2]
                at += 2
                continue
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out += pattern[at]
            at += 1
        pattern = out
    return pattern


class Vocabulary:
    """Rank table of a byte-level BPE; every single byte must have a rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.plain = ranks, pattern, plain_pattern(pattern)
        self.entries = list(ranks)
        self.ids = list(ranks.values())
        self.hash = PerfectHash(self.entries)
        self.pieces = {i: b for b, i in ranks.items()}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Vocabulary:
        """``path``: lines of a base64 token and its rank."""
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        found = self.hash.find(piece)
        if found >= 0 and self.entries[found] == piece:
            return [self.ids[found]]
        return self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until no pair has a rank."""
        n, rank = len(piece), self.ranks.get
        end = list(range(1, n + 1))  # of the part that starts here; 0: it is inside another part
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, left, stop = heapq.heappop(heap)
            right = end[left]
            if not right or right >= n or end[right] != stop:
                continue  # one of the two parts has changed since
            end[left], end[right] = stop, 0
            if stop < n:
                before[stop] = left
                if (r := rank(piece[left:end[stop]])) is not None:
                    heapq.heappush(heap, (r, left, end[stop]))
            if (prior := before[left]) >= 0 and (r := rank(piece[prior:stop])) is not None:
                heapq.heappush(heap, (r, prior, stop))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[piece[at:end[at]]])
            at = end[at]
        return out

    def remembered(self) -> dict[str, list[int]]:
        return _Ids(self.encode_piece)

    def encode(self, texts: Iterable[str], known: dict[str, list[int]]) -> Iterator[np.ndarray]:
        """Ids of each text; ``known`` comes from ``remembered()`` and is kept between calls."""
        plain, full = re.compile(self.plain).findall, regex.compile(self.pattern).findall
        for text in texts:
            pieces = plain(text) if text.isascii() or 2 * len(text) == len(text.encode("utf-16-le")) else full(text)
            yield np.fromiter(chain.from_iterable(map(known.__getitem__, pieces)), dtype=np.int32)
            if len(known) > REMEMBERED:
                known.clear()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def _with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def _require_free(df: DataFrame, name: str) -> None:
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"column {name} is there already")


def _added(df: DataFrame, name: str, kind) -> StructType:
    return StructType([*df.schema.fields, StructField(name, kind)])


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of the whole text; a null or empty text has none (an empty array).

    All other columns are kept as they are, repeated rows too. ``out`` must be a new name.
    """
    _require_free(df, out)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.remembered()
        for batch in batches:
            texts = (v.as_py() or "" for v in batch.column(at))
            parts = list(shared.value.encode(texts, known))
            starts = np.cumsum([0, *map(len, parts)], dtype=np.int64)
            flat = np.concatenate([np.empty(0, np.int32), *parts])
            yield _with_column(batch, out, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat)))

    return df.mapInArrow(run, _added(df, out, ArrayType(IntegerType())))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes of the ids; null ids give null, an id outside the vocabulary ends the job."""
    _require_free(df, out)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            made = [shared.value.decode(v.values.to_numpy().tolist()) if v.is_valid else None for v in column]
            yield _with_column(batch, out, pa.array(made, pa.binary()))

    return df.mapInArrow(run, _added(df, out, BinaryType()))


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): what encoding gives and decoding gives back."""
    coded = encode(docs.select(key, text), vocabulary, text, "_ids").select(
        key, "_ids", F.size("_ids").cast("long").alias("n_tokens"), ids_digest(F.col("_ids")).alias("ids_sha256"))
    return decode(coded, vocabulary, "_ids", "_bytes").select(
        key, "n_tokens", "ids_sha256", F.sha2("_bytes", 256).alias("decoded_sha256"))
