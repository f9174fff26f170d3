"""Remove the words of every window of ``SIZE`` words that also starts elsewhere.

A count-min sketch comes first. What it counts of a window is its anchor: of the runs of ``ANCHOR`` words in
the window the leftmost with the least hash. Equal windows have equal anchors at different places, so the count
of an anchor is never below that of its windows, and anchors are some ten times fewer. Tasks send the cells of
their anchors, which are added up by ranges of cells into one bit a cell: whether it was hit twice.

Windows whose cells were all hit twice are then grouped exactly, by 128-bit hashes of their words. Only windows
that turn out to be alone go back to their document, where all other estimated windows are repeated. A passage
that very many documents share is thus one group of counts, and never comes together.

The sketch has ``ROWS`` rows of four cells per expected anchor, 2^``MAX_BITS`` at most, which bounds what is
broadcast to ``ROWS`` * 2^``MAX_BITS`` bits; with more data than that suits more windows are grouped, none is lost.

Rows: a null text has no words; texts shorter than a window lose nothing; repeated rows lose what they share;
null ids are no exception; other columns stay as they are. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparselin.llm.store import extended, input_bytes, map_batches, named, others, partitions, slices, unused
from sparselin.llm.words import U64, Words, chain, mix, words_of
from sparselin.session import ship_package

SIZE = 35
ANCHOR = 16
ROWS = 2
MAX_BITS = 29
RANGE_BITS = 20
COUNTS = "n_words long, n_removed long"
# Anchors a task holds before it sends their cells.
SEND = 1 << 20


def leftmost_least(values: np.ndarray, size: int) -> np.ndarray:
    """Position of the leftmost least of ``size`` consecutive values, for every start."""
    at, reach = np.arange(len(values)), 1
    while reach < size and len(at):
        shift = min(reach, size - reach)
        a, b = at[:-shift], at[shift:]
        at = np.where(values[a] <= values[b], a, b)
        reach += shift
    return at


def anchors(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``ANCHOR`` words, and for every window the position of its anchor."""
    width = min(ANCHOR, size)
    runs = chain(hashes, width, salt=7)
    return runs, leftmost_least(runs, size - width + 1)


def cells(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(values + U64((row + 1) * 0xA0761D6478BD642F & (1 << 64) - 1)) >> U64(64 - bits)).astype(np.int64)


def sketch_bits(docs: DataFrame, size: int) -> int:
    """Four cells per anchor, guessed from the bytes of the input; a matter of speed only."""
    found = input_bytes(docs) / 4 * 2 / max(size - ANCHOR + 2, 2)
    return int(np.clip(np.ceil(np.log2(max(4 * found, 1))), RANGE_BITS, MAX_BITS))


def sketch(docs: DataFrame, size: int, bits: int) -> list[np.ndarray]:
    """For each row of the sketch one bit a cell: whether two anchors or more hit it."""
    spark = docs.sparkSession
    ship_package(spark)

    def send(held):
        values = np.concatenate(held)
        keys, parts = [], []
        for row in range(ROWS):
            found = np.sort(cells(values, row, bits))
            area = found >> RANGE_BITS
            edges = np.flatnonzero(np.diff(area, prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:]):
                keys.append((row, int(area[a])))
                parts.append((found[a:b] & ((1 << RANGE_BITS) - 1)).astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array(parts, pa.binary())],
            names=["row", "area", "cells"])

    def count(batches):
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, 1 << 22):
                words = words_of(part.column(0))
                runs, at = anchors(words.hashes(), size)
                place = at[words.windows(size)]
                held.append(runs[place[np.diff(place, prepend=-1) != 0]])
                n += len(held[-1])
                if n >= SEND:
                    yield send(held)
                    held, n = [], 0
        if n:
            yield send(held)

    def merge(batches):
        key, hits = None, None
        done = []
        for batch in batches:
            for row, area, part in zip(*(c.to_pylist() for c in batch.columns)):
                if (row, area) != key:
                    if key is not None:
                        done.append((*key, np.packbits(hits >= 2, bitorder="little").tobytes()))
                    key, hits = (row, area), np.zeros(1 << RANGE_BITS, np.uint8)
                more = np.bincount(np.frombuffer(part, "<u4"), minlength=1 << RANGE_BITS)
                hits = np.minimum(hits + np.minimum(more, 2), 2).astype(np.uint8)
        if key is not None:
            done.append((*key, np.packbits(hits >= 2, bitorder="little").tobytes()))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.binary())],
                names=["row", "area", "bits"])

    sent = docs.select("text").mapInArrow(count, "row int, area long, cells binary")
    merged = sent.repartition(partitions(spark), "row", "area").sortWithinPartitions("row", "area").mapInArrow(
        merge, "row int, area long, bits binary")
    out = [np.zeros(1 << bits - 3, np.uint8) for _ in range(ROWS)]
    step = 1 << RANGE_BITS - 3
    # One bit a cell, so no more than the bound of the sketch.
    for batch in merged.toArrow().to_batches():
        for row, area, part in zip(*batch.columns):
            at = area.as_py() * step
            out[row.as_py()][at:at + step] = np.frombuffer(part.as_buffer(), np.uint8)
    return out


def estimated(words: Words, hashes: np.ndarray, size: int, bits: int, twice: list[np.ndarray]) -> np.ndarray:
    """Windows whose anchor hits only cells that were hit twice."""
    runs, at = anchors(hashes, size)
    found = words.windows(size)
    for row, hit in enumerate(twice):
        cell = cells(runs[at[found]], row, bits)
        found = found[(hit[cell >> 3] >> (cell & 7) & 1).astype(bool)]
    return found


def remove_repeated(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` (``text`` and more): ``text`` holds the words kept, joined by blanks; ``n_words``, ``n_removed``.

    Columns of those names are replaced.
   """
    spark = docs.sparkSession
    bits = sketch_bits(docs, size)
    twice = spark.sparkContext.broadcast(sketch(docs, size, bits))
    names, row, alone_here = others(docs, COUNTS), unused(docs, "_row"), unused(docs, "_alone")
    keyed = docs.withColumn(row, F.xxhash64(*[c for c in ("doc_id", "text") if c in names]))

    def windows(part):
        words = words_of(part.column(1))
        hashes = words.hashes()
        found = estimated(words, hashes, size, bits, twice.value)
        owner = np.searchsorted(words.bounds, found, "right") - 1
        yield pa.RecordBatch.from_arrays(
            [part.column(0).take(pa.array(owner)), pa.array((found - words.bounds[owner]).astype(np.int32)),
             pa.array(chain(hashes, size, salt=1)[found].view(np.int64)), pa.array(chain(hashes, size, salt=2)[found].view(np.int64))],
            names=["_row", "at", "a", "b"])

    # A window that is alone has one place, and any aggregate over one row is that row.
    alone = (map_batches(keyed.select(F.col(row).alias("_row"), "text"), windows, "_row long, at int, a long, b long")
             .groupBy("a", "b").agg(F.count("*").alias("n"), F.max("_row").alias("_row"), F.max("at").alias("at")).where("n = 1")
             .groupBy(F.col("_row").alias(row)).agg(F.collect_list("at").alias(alone_here)))
    joined = keyed.join(alone.hint("shuffle_hash"), row, "left").select(*named([*names, alone_here]))

    def remove(part):
        place = names.index("text")
        texts = part.column(place)
        words = words_of(texts)
        found = estimated(words, words.hashes(), size, bits, twice.value)
        lists = part.column(len(names))
        single = lists.flatten().to_numpy().astype(np.int64)
        single = single + np.repeat(words.bounds[:-1], lists.value_lengths().fill_null(0).to_numpy())
        found = np.setdiff1d(found, single, assume_unique=True)
        n = len(words.starts) + 1
        covered = np.bincount(found, minlength=n) - np.bincount(found + size, minlength=n)
        gone = np.cumsum(covered)[:-1] > 0
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.bounds[:-1]) * (words.counts() > 0)
        raw, keep = words.body.tobytes(), ~gone
        kept = []
        for a, b in zip(words.bounds, words.bounds[1:]):
            mine = keep[a:b]
            kept.append(b" ".join([raw[s:s + n] for s, n in zip(words.starts[a:b][mine].tolist(), words.sizes[a:b][mine].tolist())]).decode())
        columns = [*part.columns[:place], pa.array(kept, pa.string()), *part.columns[place + 1:len(names)]]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(words.counts()), pa.array(removed)], names=[*names, "n_words", "n_removed"])

    return map_batches(joined, remove, extended(docs, names, COUNTS))
