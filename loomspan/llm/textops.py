"""Vectorised work on the UTF-8 bytes of a batch of texts."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a run of texts; the arrays made for it take some fifty times as much.
CHUNK = 1 << 19
#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}
#: Bytes of powers that a worker keeps for each base.
KEPT = 8 << 20


def lean(work):
    """A worker's function that gives freed memory back to the system at its end, as the worker lives on."""

    @functools.wraps(work)
    def run(it):
        try:
            yield from work(it)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; as many as a run of texts needs are kept between calls."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        size = max(n, CHUNK + (1 << 14))
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        got = np.cumprod(steps, dtype=np.uint64)
        if got.nbytes <= KEPT:
            _POWERS[base] = got
    return got[:n]


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def slices(column, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about limit bytes: (first row, end row, bytes, offsets from 0). A longer text stands alone, whole."""
    raw, at = column_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True; a run never crosses a text's bounds."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = offsets[:-1]
    at = at[at < n]
    first[at] = inside[at]
    prev = offsets[1:] - 1
    prev = prev[prev >= 0]
    last[prev] |= inside[prev]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums whose differences give the polynomial hash of any stretch."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def stretch_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [start, end)."""
    h = (prefix[ends] - prefix[starts]) * powers(UNBASE, len(prefix))[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def count_in(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the ascending points lie in each text."""
    return np.diff(np.searchsorted(points, offsets))


def sum_in(values: np.ndarray, bounds: np.ndarray, dtype=np.int64) -> np.ndarray:
    """Sums of values over the runs between bounds; an empty run gives 0."""
    c = np.zeros(len(values) + 1, dtype=dtype)
    np.cumsum(values, out=c[1:])
    return c[bounds[1:]] - c[bounds[:-1]]


def exact_words(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(index of each word, the distinct words as bytes): words are told apart by their bytes, not by a hash. inside marks the bytes of words."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    flat = data[inside]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary
