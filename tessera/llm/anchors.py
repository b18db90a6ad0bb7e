"""Sampled suffixes of byte strings: places that only the text around them decides.

Of each window of ``window`` grams of ``gram`` bytes, the place of the gram with
the least hash (the first of equals) is sampled.  Two equal strings of ``gram +
window - 1`` bytes therefore have the same sampled place inside, wherever they
stand.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, BASE, np.uint64), dtype=np.uint64)
        down = np.cumprod(np.full(n, inverse, np.uint64), dtype=np.uint64)
    return np.r_[np.uint64(1), up], np.r_[np.uint64(1), down]


class Hasher:
    """64-bit hashes of any slice of a text, from prefix sums."""

    table = _powers(1 << 16)
    mixer = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 62, 256).astype(np.uint64)

    def __init__(self, raw: np.ndarray):
        if len(Hasher.table[0]) <= len(raw):
            Hasher.table = _powers(2 * len(raw))
        self.up, self.down = Hasher.table
        self.prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(Hasher.mixer[raw] * self.up[: len(raw)], out=self.prefix[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), mixed so that all bits depend on all bytes; the length counts too."""
        h = (self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def sliding_min(values: np.ndarray, window: int) -> np.ndarray:
    """Minimum of each window, by doubling."""
    width = 1
    while width * 2 <= window:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (window - width)], values[window - width :])


def owners(hasher: Hasher, n: int, gram: int, window: int) -> np.ndarray:
    """For each string of ``gram + window - 1`` bytes of a text of ``n`` (under 16 million), by its start: the sampled place inside.

    Hashes are compared by their upper 40 bits, whatever the text's length, so
    that equal strings decide alike in all texts.
    """
    if n < gram + window - 1:
        return np.zeros(0, np.int64)
    at = np.arange(n - gram + 1)
    h = hasher.slices(at, at + gram)
    bits = np.uint64(24)
    low = sliding_min(h >> bits << bits | at.astype(np.uint64), window)
    return (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
