"""Simple-8b word-aligned coding of token ids, in NumPy.

A 64-bit word holds a 4-bit selector in its high bits and up to 60 values of equal width below it, the first
in the lowest bits. Values are cut into blocks of ``BLOCK``; no word crosses a block, and the block table
holds the place of each block's first word, so that blocks are coded and decoded side by side. A value of
more than 60 bits is an escape: a word with the escape selector, then the value as a word of its own.
"""

from __future__ import annotations

import numpy as np

from sparselin.llm.words import U64, spread_runs

BLOCK = 512
# Selector: values in a word, and their width in bits. The last selector is the escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64])
ESCAPE = len(COUNTS) - 1


def widths_of(values: np.ndarray) -> np.ndarray:
    """Bits each value needs; at least one."""
    low = values.astype(np.float64)
    out = np.maximum(np.frexp(low)[1], 1)
    # The conversion may round up to the next power of two.
    out -= (out > 1) & ((values >> (out - 1).astype(U64)) == 0)
    return out.astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the number of words before each block."""
    values = values.astype(U64)
    n = len(values)
    if not n:
        return np.empty(0, U64), np.empty(0, np.uint32)
    blocks = -(-n // BLOCK)
    last = np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    # The narrowest selector whose next values all fit and lie in the block, at every place.
    need = widths_of(values)
    room = np.repeat(last, np.diff(np.concatenate([[0], last]))) - np.arange(n)
    selector = np.full(n, ESCAPE, np.uint8)
    for s in range(ESCAPE - 1, -1, -1):
        count, fits = int(COUNTS[s]), need <= WIDTHS[s]
        if not fits.any():
            break
        if count == 1:
            selector[fits] = s
            continue
        if count > n:
            continue
        bad = np.concatenate([[0], np.cumsum(~fits)])
        selector[:n - count + 1][(bad[count:] == bad[:-count]) & (room[:n - count + 1] >= count)] = s
    step = COUNTS[selector]
    # All blocks advance together, one word at a time.
    at = last - np.diff(np.concatenate([[0], last]))
    live, heads, owner = np.arange(blocks), [], []
    while len(live):
        heads.append(at[live])
        owner.append(live)
        at[live] += step[at[live]]
        live = live[at[live] < last[live]]
    head, owner = np.concatenate(heads), np.concatenate(owner)
    head = head[order := np.argsort(head)]
    owner = owner[order]
    chosen = selector[head]
    words = np.empty(len(head), U64)
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        word = np.full(len(mine), int(s) << 60, U64)
        if s != ESCAPE:
            for k in range(int(COUNTS[s])):
                word |= values[head[mine] + k] << U64(k * int(WIDTHS[s]))
        words[mine] = word
    escaped = chosen == ESCAPE
    sizes = 1 + escaped.astype(np.int64)
    place = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), U64)
    out[place] = words
    out[place[escaped] + 1] = values[head[escaped]]
    first = np.searchsorted(owner, np.arange(blocks))
    return out, place[first].astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The values back; all words of one selector are unpacked together."""
    if not n:
        return np.empty(0, U64)
    selector = (words >> U64(60)).astype(np.int64)
    selector[selector > ESCAPE] = ESCAPE
    # The word after an escape is a value, whatever its high bits. Words are walked block by block only if any may be one.
    payload = np.zeros(len(words), bool)
    if (selector == ESCAPE).any():
        payload = payloads(selector, offsets)
    coded = np.flatnonzero(~payload)
    selector = selector[coded]
    counts = COUNTS[selector]
    place = np.cumsum(counts) - counts
    out = np.empty(n, U64)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[place[mine]] = words[coded[mine] + 1]
            continue
        count, width = int(COUNTS[s]), int(WIDTHS[s])
        shift = (np.arange(count) * width).astype(U64)
        unpacked = (words[coded[mine]][:, None] >> shift) & U64((1 << width) - 1)
        out[spread_runs(place[mine], np.full(len(mine), count))] = unpacked.ravel()
    return out


def payloads(selector: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which words are values behind an escape. All blocks advance together."""
    out = np.zeros(len(selector), bool)
    at = offsets.astype(np.int64)
    last = np.concatenate([at[1:], [len(selector)]])
    live = np.flatnonzero(at < last)
    while len(live):
        here = at[live]
        escape = selector[here] == ESCAPE
        out[here[escape] + 1] = True
        at[live] = here + 1 + escape
        live = live[at[live] < last[live]]
    return out
