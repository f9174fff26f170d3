"""Word tables of text batches in NumPy: positions and 64-bit hashes without a Python object per word.

A word is a longest run of bytes other than U+0020 and U+0009 to U+000D; UTF-8 never uses those bytes
inside another character.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
# Lower case, with ASCII characters other than letters and digits as blanks.
BARE = LOWER.copy()
BARE[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
# Keeps the first n bytes of a little-endian 8-byte load.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def join(left: np.ndarray, right: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(left * U64(0x9E3779B97F4A7C15) + (right ^ U64(salt)) + U64(0xD1B54A32D192ED03))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and the n + 1 bounds; a null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return body, bounds - bounds[0]


def span_hashes(body: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time over the spans that still have some."""
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    loads = np.lib.stride_tricks.as_strided(padded[:8].view(U64), (len(body) + 1,), (1,), writeable=False)
    out = mix(sizes.astype(U64) + U64(0x9E3779B97F4A7C15))
    first = np.minimum(sizes, 8)
    out = mix(out ^ (loads[starts] & KEEP[first]))
    left = np.flatnonzero(sizes > 8)
    at = 8
    while len(left):
        out[left] = mix(out[left] * U64(3) ^ (loads[starts[left] + at] & KEEP[np.minimum(sizes[left] - at, 8)]))
        at += 8
        left = left[sizes[left] > at]
    return out


@dataclass
class Words:
    """Words of a batch in text order. ``bounds[d]:bounds[d + 1]`` are those of text ``d``."""

    body: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hashes(self.body, self.starts, self.sizes)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def windows(self, size: int) -> np.ndarray:
        """Word positions at which a window of ``size`` words of one text starts."""
        room = np.repeat(self.bounds[1:], self.counts())
        return np.flatnonzero(np.arange(len(self.starts)) + size <= room)


def words_of(texts: pa.Array, fold: np.ndarray | None = None) -> Words:
    """``fold`` maps each byte before words are cut."""
    body, at = text_bytes(texts)
    if fold is not None:
        body = fold[body]
    inside = ~SPACE[body]
    # Texts touch each other: a word also starts or ends where its text does.
    edge = np.zeros(len(body) + 1, bool)
    edge[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first = np.flatnonzero(starts)
    sizes = np.flatnonzero(ends) + 1 - first
    return Words(body, first, sizes, np.searchsorted(first, at))


def chain(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of the ``size`` consecutive values from each position on; the last ``size - 1`` have none.

    Runs of 1, 2, 4, ... are combined by doubling, then joined to the length asked for.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    power, reach, out, covered = hashes, 1, None, 0
    while True:
        if size & reach:
            out = power[:n] if out is None else join(out, power[covered:covered + n], salt)
            covered += reach
        if covered == size:
            return mix(out ^ U64(salt)) if size == 1 else out
        power = join(power[:len(power) - reach], power[reach:], salt)
        reach *= 2


def spread_runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given lengths."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.ones(total, np.int64)
    keep = counts > 0
    starts, counts = starts[keep], counts[keep]
    heads = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out[heads] = starts
    out[heads[1:]] -= starts[:-1] + counts[:-1] - 1
    return np.cumsum(out)


def joined(words: Words, keep: np.ndarray, step: int = 1 << 18) -> pa.Array:
    """The kept words of each text, joined by blanks."""
    body = np.append(words.body, np.uint8(0x20))
    chosen = np.flatnonzero(keep)
    bounds = np.searchsorted(chosen, words.bounds)
    starts, sizes = words.starts[chosen], words.sizes[chosen]
    # The last kept word of a text has no blank behind it.
    blanks = np.ones(len(chosen), np.int64)
    blanks[bounds[1:][np.diff(bounds) > 0] - 1] = 0
    parts = []
    for at in range(0, len(chosen), step):
        some = slice(at, at + step)
        heads = np.stack([starts[some], np.full(len(starts[some]), len(words.body))], axis=1).ravel()
        parts.append(body[spread_runs(heads, np.stack([sizes[some], blanks[some]], axis=1).ravel())])
    ends = np.concatenate([[0], np.cumsum(sizes + blanks)])[bounds]
    data = pa.py_buffer(np.concatenate([*parts, np.empty(0, np.uint8)]))
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(ends.astype(np.int64)), data])
