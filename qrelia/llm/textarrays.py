"""Texts of an Arrow batch as one byte array: words, hashes of spans, slices of rows.

Everything is computed for a slice of rows at once with numpy. A span's hash is the difference of two
prefix sums of random byte values times powers of an odd base, modulo 2**64, divided by
the power at the span's start; equal byte strings have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20
_MIX1, _MIX2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class _Powers:
    """Powers of a base and of its inverse, grown on demand."""

    def __init__(self, base: int, seed: int):
        self.base, self.inverse = base | 1, _inverse(base | 1)
        self.values = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
        self.up = self.down = np.ones(1, U)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[U(1), np.full(n - 1, self.base, U)], dtype=U)
                self.down = np.cumprod(np.r_[U(1), np.full(n - 1, self.inverse, U)], dtype=U)


_POWERS = [_Powers(0x9E3779B97F4A7C15, 11), _Powers(0xD6E8FEB86659FD93, 12)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over the others."""
    h = h ^ (h >> U(33))
    h = h * _MIX1
    h ^= h >> U(33)
    h *= _MIX2
    h ^= h >> U(33)
    return h


class Prefix:
    """Prefix sums over ``symbols`` (bytes, or any 64-bit numbers) for hashes of spans."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        p = _POWERS[which]
        p.grow(len(symbols) + 1)
        self.down = p.down
        values = p.values[symbols] if symbols.dtype == np.uint8 else mix(symbols ^ U(p.base))
        self.sums = np.zeros(len(symbols) + 1, U)
        np.cumsum(values * p.up[: len(symbols)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U))

    def windows(self, width: int) -> np.ndarray:
        """Raw hash of every span of ``width`` symbols, unmixed."""
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:-width]) * self.down[:n] if n > 0 else np.empty(0, U)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``limit`` bytes; a longer row stands alone."""
    body, at = raw(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, body[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the first word of every row (one more entry than rows)."""
    if len(body) == 0:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[body]
    first = np.empty(len(body), bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    bounds = offsets[:-1][offsets[:-1] < len(body)]
    first[bounds] = True
    starts = np.flatnonzero(inside & first)
    last = np.empty(len(body), bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[bounds[bounds > 0] - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given lengths."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    keep = lengths > 0
    starts, lengths = np.asarray(starts, np.int64)[keep], lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    heads = np.cumsum(lengths)[:-1]
    step[heads] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
