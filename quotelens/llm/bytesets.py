"""Arrow text columns as flat byte arrays: words, hashes and blocks of rows, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_RNG = np.random.Generator(np.random.PCG64(20240131))
#: A random 64-bit value for each byte; POWERS go with the place of a byte in its word.
VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_PERIOD = 1 << 12
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.full(_PERIOD, BASE, np.uint64))
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over 64 bits, one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and where each row begins (one more at the end). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return flat, off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about `most` bytes of text, one row at least: bounds what the arrays derived from them take."""
    _, off = utf8(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word [^\\x20\\x09-\\x0D]+, and for each row the index of its first word (one more at the end)."""
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~SPACE[flat]
    first = np.zeros(len(flat) + 1, bool)
    first[off[:-1]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, off)


def hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each word; with `lower`, A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    within = np.arange(int(sizes.sum()), dtype=np.int64)
    heads = np.cumsum(sizes) - sizes
    within -= np.repeat(heads, sizes)
    data = flat[within + np.repeat(starts, sizes)]
    values = (VALUES[LOWER] if lower else VALUES)[data]
    values *= POWERS[within & (_PERIOD - 1)]
    if len(within) and int(sizes.max()) > _PERIOD:
        values = np.where(within >= _PERIOD, mix(values + within.astype(np.uint64)), values)
    return mix(np.add.reduceat(values, heads) + sizes.astype(np.uint64) * BASE)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries of h, over row ends too: the caller leaves those out."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out *= BASE
        out ^= out >> np.uint64(29)
        out += h[i : len(h) - n + 1 + i]
    return mix(out)


def whole(first: np.ndarray, n: int) -> np.ndarray:
    """Which of the grams of n entries lie within one row; first as words() gives it."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, bool)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return row[: total - n + 1] == row[n - 1 :]
