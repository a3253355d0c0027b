"""Vectorised rolling hashes and minima over code points."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Code points worked on at once; longer texts go through in overlapping blocks.
BLOCK = 1 << 19
_powers: dict[int, np.ndarray] = {}


def powers(base: int, size: int) -> np.ndarray:
    """base**0 ... base**(size-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < size:
        have = np.empty(max(size, BLOCK + 4096), dtype=np.uint64)
        have[0] = 1
        done, step = 1, base
        while done < len(have):
            more = min(done, len(have) - done)
            have[done : done + more] = have[:more] * np.uint64(step)
            done, step = done + more, step * step & 0xFFFFFFFFFFFFFFFF
        _powers[base] = have
    return have[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(points: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """A hash of the `width` code points from every position on; equal grams have equal hashes wherever they stand."""
    n = len(points)
    if n < width:
        return np.empty(0, dtype=np.uint64)
    inverse = _BASE_INVERSE if base == _BASE else pow(base, -1, 1 << 64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(0x51ED27)) * powers(base, n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(inverse, n - width + 1))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours: ranges are doubled, then two overlapping ones joined."""
    if len(values) < width:
        return values[:0]
    low, reach = values, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    return np.minimum(low[: len(low) - (width - reach)], low[width - reach :]) if reach < width else low
