"""Vectorised text kernels shared by the operators of this subpackage.

A batch of texts is handled as one UTF-8 byte buffer with row offsets, as Arrow
stores it.  Hashes of any span come from one prefix array: with an odd
multiplier M, ``H[i] = sum((b[j] + 1) * M**j for j < i)`` modulo 2**64, the hash
of ``[s, e)`` is ``(H[e] - H[s]) * M**-s``, mixed with the span's length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

#: Bytes 0x20 and 0x09-0x0D separate words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**0 .. M**n and their inverses, kept for later calls."""
    if "p" not in _powers or len(_powers["p"]) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        for key, base in (("p", _MULT), ("q", _INV)):
            a = np.full(size, base, dtype=U64)
            a[0] = 1
            _powers[key] = np.cumprod(a, dtype=U64)
    return _powers["p"], _powers["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a byte buffer or an array of 64-bit symbols."""
    p, _ = powers(len(values))
    h = np.empty(len(values) + 1, dtype=U64)
    h[0] = 0
    x = values.astype(U64)
    x += U64(1)
    x *= p[: len(values)]
    np.cumsum(x, out=h[1:])
    return h


def spans(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end)."""
    _, q = powers(len(h))
    x = h[end] - h[start]
    x *= q[start]
    x += (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(x)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all spans of one width, by start."""
    n = len(h) - width
    if n <= 0:
        return np.empty(0, dtype=U64)
    _, q = powers(len(h))
    x = h[width:] - h[:n]
    x *= q[:n]
    x += U64(width * 0xD6E8FEB86659FD93 % (1 << 64))
    return mix(x)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def blocks(batches, column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches cut at rows so that a text column holds ``limit`` bytes at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffer(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


@cache
def _trim():
    """glibc's malloc_trim; None where the system's library has none."""
    try:
        return getattr(ctypes.CDLL(None), "malloc_trim", None)
    except (OSError, TypeError):
        return None


def tidy(run):
    """``run`` over a task's batches, giving free memory back to the system when the task ends: a worker that waits for its next task holds less."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if _trim():
                _trim()(0)

    return whole


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and row offsets into them; words end where rows end."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    inside = np.zeros(len(buf) + 1, dtype=bool)
    np.logical_not(SPACE[buf], out=inside[:-1])
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[off] = True
    start = inside[:-1].copy()
    start[1:] &= ~inside[:-2] | cut[1:-1]
    end = inside[:-1] & (~inside[1:] | cut[1:])
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off).astype(np.int64)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges [start, start + length)."""
    total = int(length.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(length) - length
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(start.astype(np.int64) - first, length)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's signed ones."""
    return x.view(np.int64)
