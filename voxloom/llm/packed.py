"""Arrays of numbers as compressed bytes, so that a shuffle carries few wide rows instead of many narrow ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard


def pack(a: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def ranges(keys: np.ndarray, width: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted keys of `width` bits, cut by their first `bits` bits."""
    part = (keys >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(keys) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(part[a]), int(a), int(b)
