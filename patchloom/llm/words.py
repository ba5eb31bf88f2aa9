"""Words, shingles and windows of whole texts as numpy arrays, for use inside Spark tasks.

A word is a run of bytes other than space and 0x09-0x0D. Hashes are 64-bit polynomials of the
bytes (for words) or of mixed word hashes (for runs of words), taken from running sums, so that
a batch of texts costs a fixed number of array operations and no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, at least ``n`` of each."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        known = _POWERS[base] = (made[0], made[1])
    return known


def _running(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


class Words:
    """The words of one or more texts: ``hashes``, and for text k the words ``first[k]:first[k + 1]``."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b" ".join(texts) + b" "
        self.data = np.frombuffer(joined, dtype=np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        solid = ~_IS_SPACE[self.data]
        edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        if len(solid) and solid[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        sums = _running(self.data.astype(np.uint64) + np.uint64(1), _BYTE_BASE)
        inverse = _powers(_BYTE_BASE, len(self.data) + 1)[1]
        self.hashes = mix((sums[self.end] - sums[self.start]) * inverse[self.start])
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, begin)

    def runs(self, length: int, which: int = 0) -> np.ndarray:
        """Hash of the ``length`` words from each word on; the last ones cross into the next text."""
        base = _WORD_BASES[which]
        n = len(self.hashes)
        if n < length:
            return np.zeros(0, dtype=np.uint64)
        sums = _running(self.hashes, base)
        inverse = _powers(base, n + 1)[1]
        return mix((sums[length:] - sums[: n + 1 - length]) * inverse[: n + 1 - length])


def batches(values: Iterable[bytes | None], limit: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) in batches of about ``limit`` bytes; a longer text is alone."""
    first, size, batch = 0, 0, []
    for i, v in enumerate(values):
        v = v or b""
        if batch and size + len(v) > limit:
            yield first, batch
            first, size, batch = i, 0, []
        batch.append(v)
        size += len(v) + 1
    if batch:
        yield first, batch
