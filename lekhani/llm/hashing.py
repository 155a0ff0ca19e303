"""64-bit fingerprints in numpy, many at a time."""

from __future__ import annotations

import numpy as np
import xxhash

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each number."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A fingerprint of the bytes of each span, the same wherever it stands.

    Spans of up to 8 bytes are numbers themselves, mixed one to one; longer ones go through XXH3.
    """
    n = end - start
    at = np.ndarray(len(data) + 1, "<u8", data + bytes(8), 0, (1,))[start]  # the 8 bytes from each start on
    short = np.minimum(n, 8).astype(np.uint64)
    at = np.where(short < 8, at & ((np.uint64(1) << (short * np.uint64(8) & np.uint64(63))) - np.uint64(1)), at)
    out = mix(mix(at) + n.astype(np.uint64) * GOLDEN)
    long = np.flatnonzero(n > 8)
    if len(long):
        digest = xxhash.xxh3_64_intdigest
        out[long] = np.fromiter((digest(data[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)), np.uint64, len(long))
    return out
