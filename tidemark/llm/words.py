"""Words of whole Arrow text columns as numpy arrays: spans, 64-bit hashes, document offsets.

Everything works on the UTF-8 bytes, so that a batch of texts is cut into words by a few
array operations and no Python string is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once (a longer document is a block of its own).
BLOCK_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True

#: Separators of the contamination rule: what is neither a digit, a letter a-z (after lower-casing) nor beyond ASCII.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[0x00:0x30] = NON_ALNUM[0x3A:0x41] = NON_ALNUM[0x5B:0x61] = NON_ALNUM[0x7B:0x80] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER] | np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) <= n:
        n = max(n, BLOCK_BYTES)
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        if n > 4 * BLOCK_BYTES:  # for one very long text: not kept
            return made[0], made[1]
        _powers = (made[0], made[1])
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Documents lo to hi of a batch: their bytes and where each begins."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def words(self, separators: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and for each document where its words begin (one more at the end)."""
        n = len(self.data)
        inside = np.zeros(n + 2, bool)
        np.logical_not(separators[self.data], out=inside[1 : n + 1])
        starts = inside[1:] & ~inside[:-1]
        ends = ~inside[1:] & inside[:-1]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        glued = cuts[inside[cuts] & inside[cuts + 1]]  # a document ends and the next begins within a run
        starts[glued] = ends[glued] = True
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of spans, the same wherever a span stands; A-Z count as a-z."""
        powers, inverse = _tables(len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_MIX[self.data] * powers[: len(self.data)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * inverse[starts])


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """A text column (nulls as empty texts), in blocks of about `limit` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi
