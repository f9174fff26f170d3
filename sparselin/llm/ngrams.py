"""Hashed character n-grams of texts, in NumPy."""

from __future__ import annotations

import numpy as np

from sparselin.llm.words import U64

STEP = U64(0x9E3779B97F4A7C15)


def features(texts: list[str], orders: range, bits: int, salt: int = 0, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``(text, feature)`` of every n-gram occurrence, text by text within each order.

    A text is framed by the marks U+0001 and U+0002, so n-grams at its ends differ from those inside.
    """
    joined = "\0".join("\1" + t.replace("\0", " ") + "\2" for t in texts) + "\0"
    points = np.frombuffer((joined.lower() if fold else joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(points == 0)
    sizes = np.diff(np.concatenate([[-1], ends]))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    left = np.repeat(ends, sizes).astype(np.int32) - np.arange(len(points), dtype=np.int32)
    values = points.astype(U64) + U64(1)
    texts_of, found = [], []
    h = np.full(len(points), U64((salt * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    for order in range(1, orders.stop):
        n = len(points) - order + 1
        if n <= 0:
            break
        h = (h[:n] ^ values[order - 1:]) * STEP
        h ^= h >> U64(29)
        if order >= orders.start:
            inside = left[:n] >= order
            texts_of.append(owner[:n][inside])
            found.append(((h[inside] * U64(0xBF58476D1CE4E5B9)) >> U64(64 - bits)).astype(np.int32))
    return np.concatenate(texts_of or [np.empty(0, np.int32)]), np.concatenate(found or [np.empty(0, np.int32)])


def distinct(owner: np.ndarray, feature: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a text once."""
    pairs = np.unique(owner.astype(np.int64) << bits | feature)
    return pairs >> bits, pairs & ((1 << bits) - 1)


def logistic(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))
