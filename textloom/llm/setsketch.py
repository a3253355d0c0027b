"""SetSketch (Ertl, 2021): mergeable, locality-sensitive sketches of sets, and their joint likelihood.

Register i of a set is floor(1 - log_b(min h_i)) over its elements, cut off to 0..q+1, where h_i is exponential
with rate a: minima on an exponentially spaced scale. The sketch of a union is the register-wise maximum. For b near
1 two registers are equal about as often as the sets' Jaccard similarity, so equal runs of registers (bands) find
similar sets, and the counts of greater, less and equal registers give the similarity by maximum likelihood. How often
registers of sets without a common element are equal, about (b - 1) / 4, decides how many candidates are false: with
b = 1.001 that is once in about 4,000, and a band of registers hardly ever agrees by chance; what candidates are false
come from sets that do share elements.
"""

from __future__ import annotations

import math

import numpy as np

BASE = 1.001
RATE = 20.0
TOP = 65_534  # q; registers fit two bytes for sets of any size that occurs


def register_seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20210117)
    return rng.integers(0, 1 << 32, m, dtype=np.uint32), rng.integers(0, 1 << 31, m, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def sketch(elements: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """Registers (sets x m, uint16) of sets of well mixed 64-bit hashes; set k is elements[starts[k]:starts[k+1]] and not empty."""
    low = (elements ^ (elements >> np.uint64(32))).astype(np.uint32)
    least = np.empty((len(starts), m), dtype=np.uint32)
    for i, (salt, odd) in enumerate(zip(*register_seeds(m))):
        x = low ^ salt
        x *= odd
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        least[:, i] = np.minimum.reduceat(x, starts)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1.0 - np.log(exponential) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(one, other)


def cardinality(registers: np.ndarray) -> np.ndarray:
    """Number of elements, estimated from the registers (last axis)."""
    m = registers.shape[-1]
    total = np.sum(np.power(BASE, -registers.astype(np.float64)), axis=-1)
    return m * (1 - 1 / BASE) / (RATE * math.log(BASE) * total)


def collision(x: np.ndarray) -> np.ndarray:
    """Probability that a register of one set is the greater one, for the share x of the union that only this set holds."""
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def jaccard(one: np.ndarray, other: np.ndarray, size_one: np.ndarray, size_other: np.ndarray, steps: int = 101) -> np.ndarray:
    """Maximum-likelihood similarity of each row of registers and the like row of the other, the sizes being known."""
    m = one.shape[1]
    more, less = (one > other).sum(axis=1), (one < other).sum(axis=1)
    u = size_one / (size_one + size_other)
    v = 1 - u
    best, value = np.zeros(len(one)), np.full(len(one), -np.inf)
    most = np.minimum(u, v) / np.maximum(u, v)
    for step in range(steps):
        j = most * (step / (steps - 1)) * (1 - 1e-9)
        p, q = collision(np.maximum(u - v * j, 1e-12)), collision(np.maximum(v - u * j, 1e-12))
        score = more * np.log(np.maximum(p, 1e-300)) + less * np.log(np.maximum(q, 1e-300)) + (m - more - less) * np.log(np.maximum(1 - p - q, 1e-300))
        best, value = np.where(score > value, j, best), np.maximum(score, value)
    return best


def bands_for(threshold: float, rows: int, miss: float) -> int:
    """Bands of `rows` registers so that sets at the threshold are missed with at most the probability `miss`.

    The rarest collisions are those of sets as unequal in size as the threshold allows, so these set the number."""
    u = 1 / (1 + threshold)
    unequal = 1 - collision(np.array(u - (1 - u) * threshold)) - collision(np.array(1e-15))
    equal = 1 - 2 * collision(np.array((1 - threshold) / 2))
    p = float(min(unequal, equal)) ** rows
    return math.ceil(math.log(miss) / math.log(1 - p))
