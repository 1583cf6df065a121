"""Compressed arrays and the bucket exchange that counts hashed keys over the whole corpus.

Batches of documents ask for facts about their distinct keys. A request row
holds a batch's sorted keys of one bucket, so a key costs a few bytes and not a
row; buckets are uniform because keys are hashes and a batch names a key once,
however often it occurs. Answers go back by batch.
"""

from __future__ import annotations

import numpy as np
import zstandard

_PACK = zstandard.ZstdCompressor(level=1)
_UNPACK = zstandard.ZstdDecompressor()


def packed(a: np.ndarray) -> bytes:
    """An array as bytes: each byte plane compressed by itself, so that a plane of few values is not coded with random ones; planes of zeros are left out.

    Layout: length (u32), then for each plane its size (u32) and bytes; a size
    with the top bit set is a plane as it is.
    """
    a = np.ascontiguousarray(a)
    out = [len(a).to_bytes(4, "little")]
    if len(a):
        for plane in a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T:
            raw = plane.tobytes() if plane.any() else b""
            small = _PACK.compress(raw) if raw else b""
            keep = len(small) < len(raw)
            out += [(len(small) if keep or not raw else len(raw) | 1 << 31).to_bytes(4, "little"), small if keep or not raw else raw]
    return b"".join(out)


def unpacked(raw: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    n = int.from_bytes(raw[:4], "little")
    planes, at = np.zeros((n, kind.itemsize), np.uint8), 4
    for k in range(kind.itemsize if n else 0):
        size = int.from_bytes(raw[at : at + 4], "little")
        as_is, size = size >> 31, size & ((1 << 31) - 1)
        body, at = raw[at + 4 : at + 4 + size], at + 4 + size
        if size:
            planes[:, k] = np.frombuffer(body if as_is else _UNPACK.decompress(body), np.uint8)
    return planes.view(kind).ravel()


def packed_steps(a: np.ndarray) -> bytes:
    """Sorted or partly sorted unsigned keys by their differences, modulo the word."""
    return packed(np.diff(a, prepend=a[:1] * 0) if len(a) else a)


def unpacked_steps(raw: bytes, kind) -> np.ndarray:
    return np.cumsum(unpacked(raw, kind), dtype=kind)


def squeezed(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def restored(raw: bytes) -> bytes:
    return _UNPACK.decompress(raw)


def by_bucket(keys: np.ndarray, buckets: int, then: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): keys[order] is sorted by bucket, key and then; bounds delimit the buckets."""
    where = keys % np.uint64(buckets)
    order = np.lexsort((keys, where) if then is None else (then, keys, where))
    return order, np.searchsorted(where[order], np.arange(buckets + 1, dtype=np.uint64))
