"""Words of whole texts as numpy arrays, straight from Arrow's buffers.

All word patterns in use separate words by ASCII bytes only, so the bytes of UTF-8 can be
classified one by one. A block holds the texts of several rows; no word spans two rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vendorlens.llm.common import BLOCK_BYTES

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finaliser of shifts and odd multipliers)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: np.uint64, n: int, start: int = 0) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


#: Bytes or words that are summed up at once, so that the arrays for it don't grow with a text.
STRETCH = 1 << 16


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64; those for a usual stretch are kept."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.empty(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > 2 * STRETCH:  # one very long word: not kept
            return _powers(self.base, n), _powers(self.inverse, n)
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, 2 * STRETCH), _powers(self.inverse, 2 * STRETCH)
        return self.up, self.down


_BYTE_POWERS = _Powers(0x2545F4914F6CDD1D)
_WORD_POWERS = _Powers(0x5851F42D4C957F2D)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of an odd number modulo 2**64, and of its inverse."""
    return _powers(_WORD_POWERS.base, n), _powers(_WORD_POWERS.inverse, n)


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def separators(pattern: str) -> np.ndarray:
    """256 booleans: bytes between words. 'space': ASCII white space; 'ascii': all ASCII but letters and digits."""
    sep = np.zeros(256, bool)
    if pattern == "space":
        sep[[0x20, 9, 10, 11, 12, 13]] = True
    elif pattern == "ascii":
        sep[:0x30] = sep[0x3A:0x61] = sep[0x7B:0x80] = True
    else:
        raise ValueError(pattern)
    return sep


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    to = np.arange(256, dtype=np.uint8)
    to[65:91] += 32
    return to[data]


@dataclass
class Block:
    """Words of rows ``lo`` to ``hi`` of a batch. ``first[i]:first[i+1]`` are the words of row lo + i."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        """The row (from 0 in this block) of each word."""
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, by its bytes alone."""
        out = np.empty(len(self.starts), np.uint64)
        lo = 0
        while lo < len(out):
            base = int(self.starts[lo])
            hi = max(lo + 1, int(np.searchsorted(self.ends, base + STRETCH, "right")))
            starts, ends = self.starts[lo:hi] - base, self.ends[lo:hi] - base
            n = int(ends[-1])
            up, down = _BYTE_POWERS.get(n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE_VALUE[self.data[base : base + n]] * up[:n], out=sums[1:])
            h = (sums[ends] - sums[starts]) * down[starts]
            out[lo:hi] = mix(h + (ends - starts).astype(np.uint64) * _BASE)
            lo = hi
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def blocks(column: pa.Array, pattern: str, lower: bool, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The words of every whole text, block by block."""
    sep = separators(pattern)
    data, offsets = texts(column)
    for lo, hi in row_blocks(offsets, limit):
        own = data[offsets[lo] : offsets[hi]]
        cuts = offsets[lo : hi + 1] - offsets[lo]
        if lower:
            own = lower_bytes(own)
        inside = ~sep[own]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        edge = cuts[1:-1]
        edge = edge[(edge > 0) & (edge < len(own))]
        begins[edge] = inside[edge]  # a row ends a word
        stops[edge - 1] = inside[edge - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        yield Block(lo, hi, own, starts, ends, np.searchsorted(starts, cuts))


def windows(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every run of ``width`` words inside one row."""
    n = len(h)
    if n < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    if width <= 12:
        total = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            total += h[j : n - width + 1 + j] * np.uint64(pow(int(_STEP), j, 1 << 64))
    else:
        total = np.empty(n - width + 1, np.uint64)
        for at in range(0, len(total), STRETCH):
            own = h[at : at + STRETCH + width - 1]
            up, down = _WORD_POWERS.get(len(own) + 1)
            sums = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(own * up[: len(own)], out=sums[1:])
            total[at : at + STRETCH] = (sums[width:] - sums[:-width]) * down[: len(own) - width + 1]
    last = np.repeat(first[1:], np.diff(first))[: n - width + 1]  # end of the row of each word
    start = np.arange(n - width + 1)
    ok = start + width <= last
    return start[ok], mix(total[ok] + np.uint64(width))
