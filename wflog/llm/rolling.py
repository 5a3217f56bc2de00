"""Vectorised hashing of substrings, used to find candidates; what candidates stand for is always compared in full."""

from __future__ import annotations

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, at least n of each."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        pair = []
        for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        have = _POWERS[which] = (pair[0], pair[1])
    return have


def prefixes(codes: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums whose differences identify substrings of ``codes``."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(which, len(codes) + 1)[0][: len(codes)], out=out[1:])
    return out


def substring(p: np.ndarray, start, end, which: int = 0) -> np.ndarray:
    """Hash of codes[start:end], the same wherever the substring stands."""
    return mix((p[end] - p[start]) * powers(which, len(p))[1][start])


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))
