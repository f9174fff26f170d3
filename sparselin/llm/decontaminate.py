"""Benchmark items in documents, also with some words changed, left out or added.

Texts are sequences of lower-cased words without ASCII punctuation. A document contains an item if some
stretch of it is within ``floor(rate * item words)`` word edits of the item.

Items of fewer than ``STEPS`` words are searched for exactly. Their whole word sequence is looked up at every word
of a document, once for each distinct length. Where edits are allowed, the item is also cut into one part more than
edits: one part at least is then untouched, so looking up every part finds every match.

Candidates for longer items come from the CGK embedding: a walk reads the word under it, and a random bit of that word and of
the step says whether it moves on. After an edit two walks over otherwise equal words tend to meet again, so
sequences at a small edit distance give embeddings at a small Hamming distance. A repetition samples
``SAMPLED`` of the first ``STEPS`` coordinates of the walk; its key is equal with a fair probability for close
sequences. The item's walks start at ``STARTS`` other offsets in every repetition, spread over the whole item, the
document's at every word, which covers the window of the item's length around it whatever that length is; windows
whose first coordinate no item has at that place are left at once. ``repetitions`` derives how many are needed for the
target recall with one start; the further ones make up for walks from near offsets of short items, which are alike.
Candidates are verified by exact edit distance, so what is reported is right, and only recall is a matter of chance.

Items are sent to all tasks in blocks of at most ``BLOCK_WORDS`` words, with one pass over the documents for
each block. Walks whose key so far no item has are given up on the way. Rows: null texts and items have no words; repeated documents are judged each, repeated items give
a row each; null ids stay null; other columns stay as they are. Empty tables give no matches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparselin.llm.store import map_batches, text_column
from sparselin.llm.words import BARE, U64, Words, chain, join, mix, spread_runs, words_of

RATE = 0.2
RECALL = 0.99
STEPS = 10
SAMPLED = 5
# Walks of an item in a repetition, and how many words before its end the last one may start.
STARTS = 4
TAIL = 4
BLOCK_WORDS = 1 << 20
TABLE_BITS = 18
# Candidates whose words are compared at once.
CHECKED = 1 << 14
# Bytes of text whose walks a task holds at once.
SLICE = 1 << 20
MATCHES = "item_id long, start long, distance int, item_words int"


def repetitions(rate: float = RATE, recall: float = RECALL) -> int:
    """Repetitions of which one at least finds a match at the full rate of edits, with the target probability.

    A walk reads (STEPS + 1) / 2 words on average and is sure to agree if none is edited.
    """
    alike = (1 - rate) ** ((STEPS + 1) / 2)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - alike)))


@dataclass
class Runs:
    """Sorted hashes of runs of ``size`` words of items, whose they are and where in the item they start."""

    size: int
    keys: np.ndarray
    owner: np.ndarray
    offset: np.ndarray


@dataclass
class Items:
    """Items as word hashes, for every repetition the sorted keys of the walks of longer items, and the runs of short ones."""

    ids: list
    words: list[np.ndarray]
    pairs: np.ndarray
    first: np.ndarray
    seen: list[np.ndarray]
    keys: list[np.ndarray]
    owner: list[np.ndarray]
    offset: list[np.ndarray]
    whole: list[Runs]
    parts: list[Runs]


def seed(repetition: int) -> np.ndarray:
    return mix(np.array([repetition + 1], U64) * U64(0xE7037ED1A0B428DB))


def coordinates(repetition: int) -> list[int]:
    """The sampled steps; the first one is always among them."""
    drawn = np.random.default_rng(repetition).permutation(np.arange(1, STEPS))[:SAMPLED - 1]
    return [0, *sorted(int(x) for x in drawn)]


def walk_keys(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, repetition: int, seen=None):
    """Keys of the walks from ``starts`` that stay before ``ends``, which starts those are, and the keys on the way.

    ``seen`` holds, for each sampled coordinate, which short hashes of keys items have there; walks without
    one are given up, as no item can have their key.
    """
    moves = mix(hashes ^ seed(repetition))
    sampled = coordinates(repetition)
    alive, at = np.arange(len(starts)), starts.copy()
    key, on_the_way = np.full(len(starts), repetition, U64), []
    for step in range(sampled[-1] + 1):
        if step in sampled:
            key = join(key, hashes[at])
            if seen is None:
                on_the_way.append(short(key))
            else:
                keep = seen[sampled.index(step)][short(key)]
                alive, at, key = alive[keep], at[keep], key[keep]
        if step < sampled[-1]:
            at = at + (moves[at] >> U64(step) & U64(1)).astype(np.int64)
            inside = at < ends[alive]
            if not inside.all():
                alive, at, key = alive[inside], at[inside], key[inside]
    return key, alive, on_the_way


def short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - TABLE_BITS)).astype(np.int64)


def index(rows: list[tuple], rate: float, recall: float) -> Items:
    """Index of ``(item_id, text)`` rows."""
    texts = words_of(pa.array([t for _, t in rows], pa.string()), BARE)
    hashes = texts.hashes()
    kept = np.flatnonzero(texts.counts())
    ids = [rows[i][0] for i in kept.tolist()]
    words = [hashes[texts.bounds[i]:texts.bounds[i + 1]] for i in kept.tolist()]
    flat = np.concatenate(words) if words else np.empty(0, U64)
    sizes = np.array([len(w) for w in words], np.int64)
    begins = np.cumsum(sizes) - sizes
    n = repetitions(rate, recall)
    first = np.zeros(1 << TABLE_BITS, np.uint64)
    # Which words an item has, as hashes of both.
    pairs = np.unique(join(flat, np.repeat(np.arange(len(words)), sizes).astype(U64)))
    small = np.flatnonzero(sizes < STEPS)
    whole = runs_of(flat, begins, [(i, 0, int(sizes[i])) for i in small.tolist()])
    out = Items(ids, words, pairs, first, [], [], [], [], whole, runs_of(flat, begins, parts_of(small, sizes[small], rate)))
    long = np.flatnonzero(sizes >= STEPS)
    begins, sizes = begins[long], sizes[long]
    for r in range(n):
        # Over all repetitions, offsets go evenly over the item; the first walk of the first one starts with it.
        offset = ((sizes - TAIL + 1)[:, None] * (np.arange(STARTS) + r / n) / STARTS).astype(np.int64).ravel()
        starts = np.repeat(begins, STARTS) + offset
        # Walks that would leave the item are given up.
        key, alive, on_the_way = walk_keys(flat, starts, np.repeat(begins + sizes, STARTS), r)
        tables = np.zeros((SAMPLED, 1 << TABLE_BITS), bool)
        for table, found in zip(tables, on_the_way):
            table[found] = True
        out.seen.append(tables)
        order = np.argsort(key)
        out.keys.append(key[order])
        out.owner.append(long[alive[order] // STARTS])
        out.offset.append(offset[alive][order])
        first[short(flat[starts[alive]])] |= U64(1 << r % 64)
    return out


def parts_of(items: np.ndarray, sizes: np.ndarray, rate: float) -> list[tuple[int, int, int]]:
    """``(item, offset, words)`` of the parts, one more than edits, of the items that may have edits."""
    out = []
    for item, size in zip(items.tolist(), sizes.tolist()):
        n = int(rate * size) + 1
        cuts = [size * k // n for k in range(n + 1)]
        out += [(item, a, b - a) for a, b in zip(cuts, cuts[1:]) if n > 1]
    return out


def runs_of(flat: np.ndarray, begins: np.ndarray, spans: list[tuple[int, int, int]]) -> list[Runs]:
    """Runs of ``(item, offset, words)``, one entry for each number of words."""
    out = []
    for size in sorted({n for _, _, n in spans}):
        owner, offset = np.array([(i, o) for i, o, n in spans if n == size], np.int64).T
        keys = chain(flat, size)[begins[owner] + offset]
        order = np.argsort(keys)
        out.append(Runs(size, keys[order], owner[order], offset[order]))
    return out


def run_matches(words: Words, hashes: np.ndarray, runs: list[Runs]) -> np.ndarray:
    """Distinct ``(item, first word of the item's window)`` where a text has one of the runs."""
    found = [np.empty((0, 2), np.int64)]
    for run in runs:
        starts = words.windows(run.size)
        key = chain(hashes, run.size)[starts]
        low, high = np.searchsorted(run.keys, key, "left"), np.searchsorted(run.keys, key, "right")
        slot = spread_runs(low, high - low)
        found.append(np.stack([run.owner[slot], np.repeat(starts, high - low) - run.offset[slot]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def exact_short(words: Words, hashes: np.ndarray, items: Items) -> dict[tuple[int, int], tuple]:
    """For ``(text, item)``, the distance 0 and the place of the first exact copy of a short item."""
    item, start = run_matches(words, hashes, items.whole).T
    text = words.owner()[start]
    # Matches ascend by item and start.
    pairs, one = np.unique(np.stack([text, item], axis=1), axis=0, return_index=True)
    place = start[one] - words.bounds[pairs[:, 0]]
    return {(t, i): (0, at) for (t, i), at in zip(pairs.tolist(), place.tolist())}


def edit_match(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int]:
    """The least word edits between ``item`` and a part of ``stretch``, and where that part ends."""
    n = len(stretch)
    place = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for word in item:
        step = np.minimum(row + 1, np.concatenate([[1 << 30], row[:-1] + (stretch != word)]))
        row = np.minimum.accumulate(step - place) + place
    end = int(np.argmin(row))
    return int(row[end]), end


def candidates(words: Words, hashes: np.ndarray, items: Items) -> np.ndarray:
    """Distinct ``(item, first word of the window)`` pairs that some repetition or part of a short item finds."""
    ends = np.repeat(words.bounds[1:], words.counts())
    flags = items.first[short(hashes)]
    found = [run_matches(words, hashes, items.parts)]
    for r, keys in enumerate(items.keys):
        starts = np.flatnonzero(flags >> U64(r % 64) & U64(1))
        key, alive, _ = walk_keys(hashes, starts, ends[starts], r, items.seen[r])
        low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        slot = spread_runs(low, high - low)
        window = np.repeat(starts[alive], high - low) - items.offset[r][slot]
        found.append(np.stack([items.owner[r][slot], window], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def matches(words: Words, items: Items, rate: float) -> list[tuple]:
    """``(text, item_id, start, distance, item words)`` of the best match of each item in each text."""
    hashes = words.hashes()
    if not len(hashes) or not items.ids:
        return []
    best = exact_short(words, hashes, items)
    for item, text, low, high in plausible(words, hashes, items, rate).tolist():
        if best.get((text, item), (1,))[0] == 0 and len(items.words[item]) < STEPS:
            continue
        own, stretch = items.words[item], hashes[low:high]
        distance, end = edit_match(own, stretch)
        if distance <= int(rate * len(own)):
            # The same alignment from the other side gives the first word.
            first = low + end - edit_match(own[::-1], stretch[:end][::-1])[1]
            value = (distance, first - int(words.bounds[text]))
            if (text, item) not in best or value < best[text, item]:
                best[text, item] = value
    return [(text, items.ids[item], start, distance, len(items.words[item])) for (text, item), (distance, start) in sorted(best.items())]


def plausible(words: Words, hashes: np.ndarray, items: Items, rate: float) -> np.ndarray:
    """``(item, text, first, end)``: stretches around candidates that have as many words of the item as a match must."""
    item, start = candidates(words, hashes, items).T
    sizes = np.array([len(w) for w in items.words], np.int64)[item]
    edits = (rate * sizes).astype(np.int64)
    text = np.searchsorted(words.bounds, np.clip(start + sizes // 2, 0, len(hashes) - 1), "right") - 1
    # Windows that start within the edits of each other are covered by one stretch.
    _, one = np.unique(np.stack([text, item, start // (edits + 1)], axis=1), axis=0, return_index=True)
    item, start, sizes, edits, text = (x[one] for x in (item, start, sizes, edits, text))
    low = np.maximum(start - 2 * edits - 1, words.bounds[text])
    high = np.minimum(start + sizes + 2 * edits + 1, words.bounds[text + 1])
    found = [np.empty((0, 4), np.int64)]
    for at in range(0, len(item), CHECKED):
        part = slice(at, at + CHECKED)
        lengths = np.maximum(high[part] - low[part], 0)
        keys = join(hashes[spread_runs(low[part], lengths)], np.repeat(item[part], lengths).astype(U64))
        place = np.minimum(np.searchsorted(items.pairs, keys), len(items.pairs) - 1)
        common = np.concatenate([[0], np.cumsum(items.pairs[place] == keys)])
        ends = np.cumsum(lengths)
        enough = common[ends] - common[ends - lengths] >= sizes[part] - edits[part]
        found.append(np.stack([x[part][enough] for x in (item, text, low, high)], axis=1))
    return np.concatenate(found)


def blocks(benchmark: DataFrame, rate: float, recall: float) -> list[Items]:
    """Indexes of the items, each of a bounded number of words."""
    out, rows, size = [], [], 0
    for row in benchmark.select("item_id", text_column()).toLocalIterator():
        if rows and size + len(row["text"]) // 2 > BLOCK_WORDS:
            out.append(index(rows, rate, recall))
            rows, size = [], 0
        rows.append((row["item_id"], row["text"]))
        size += len(row["text"]) // 2 + 1
    return [*out, index(rows, rate, recall)]


def find(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL) -> DataFrame:
    """``doc_id`` and ``MATCHES`` of every document and item it contains; ``start`` counts words of the document."""
    out = None
    for items in blocks(benchmark, rate, recall):
        def task(part, items=items):
            found = matches(words_of(part.column(1), BARE), items, rate)
            owner, *columns = zip(*found) if found else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "item_id", "start", "distance", "item_words"])

        one = map_batches(docs.select("doc_id", "text"), task, f"doc_id long, {MATCHES}", SLICE)
        out = one if out is None else out.unionAll(one)
    return out


def remove(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL) -> DataFrame:
    """``docs`` without the documents that contain an item; nothing is shuffled."""
    at = docs.columns.index("text")
    schema = docs.schema
    for items in blocks(benchmark, rate, recall):
        def task(part, items=items):
            clean = np.ones(part.num_rows, bool)
            clean[[m[0] for m in matches(words_of(part.column(at), BARE), items, rate)]] = False
            yield part.filter(pa.array(clean))

        docs = map_batches(docs, task, schema, SLICE)
    return docs
