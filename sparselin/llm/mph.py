"""Minimal perfect hashing of distinct 128-bit keys, in NumPy.

Level by level, every remaining key names a bit of a bit array twice as long as the keys are many; keys alone
at their bit are done, the others go to the next level. A key's number is the count of set bits before its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from sparselin.llm.words import U64, mix

MAX_LEVELS = 64


def places(a: np.ndarray, b: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(a ^ mix(b + U64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))) % U64(bits)).astype(np.int64)


@dataclass
class PerfectHash:
    """``words`` hold the bits of all levels, ``starts`` the first bit of each level and the end."""

    words: np.ndarray
    starts: np.ndarray

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        parts, starts, level = [], [0], 0
        while len(a):
            if level == MAX_LEVELS:
                raise ValueError("the keys are not distinct")
            bits = -(-2 * len(a) // 64) * 64
            at = places(a, b, level, bits)
            alone = np.bincount(at, minlength=bits) == 1
            parts.append(np.packbits(alone, bitorder="little").view(U64))
            starts.append(starts[-1] + bits)
            rest = ~alone[at]
            a, b, level = a[rest], b[rest], level + 1
        return cls(np.concatenate(parts) if parts else np.empty(0, U64), np.array(starts, np.int64))

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each key, or -1 for some keys that were not among those of the build."""
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        out = np.full(len(a), -1, np.int64)
        open_ = np.arange(len(a))
        for level, (start, end) in enumerate(zip(self.starts, self.starts[1:])):
            if not len(open_):
                break
            at = start + places(a[open_], b[open_], level, end - start)
            word, bit = at >> 6, (at & 63).astype(U64)
            hit = (self.words[word] >> bit) & U64(1) == 1
            lower = self.words[word] & ((U64(1) << bit) - U64(1))
            out[open_[hit]] = (before[word] + np.bitwise_count(lower))[hit]
            open_ = open_[~hit]
        return out
