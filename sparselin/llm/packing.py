"""Best-fit packing of pieces into sequences of a fixed size, in bulk.

Pieces of one length are interchangeable, and so are sequences with one gap. Both are therefore kept as
runs: range-sorted by descending length, the pieces get ranks, and a length is a run of ranks; sequences
with equal content are a run of consecutive sequence ids. A round matches the longest unplaced length with
its successor, the smallest gap that holds it: as many sequences of that run as there are pieces for are filled with
that length at once, one more takes the rest, and the run moves to its smaller gap. Rounds repeat
until all lengths are placed; new sequences open where no gap is large enough. The runs number some times
``size`` whatever the data, so rounds need no data; the pieces then find their run by rank, in parallel.

Rows: every piece is placed; repeated rows are pieces of their own; null ids sort first; a length outside
1 to ``size`` is an error. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparselin.llm.store import Scratch, extended, map_batches, named, others, partitions, unused

PLACES = "sequence_id long, offset long"


class Gaps:
    """Runs of sequences by their gap, with the smallest gap of at least a length at hand."""

    def __init__(self):
        self._runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def successor(self, length: int, size: int) -> int | None:
        return next((g for g in range(length, size + 1) if self._runs.get(g)), None)

    def push(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            heapq.heappush(self._runs[gap], (first, count))

    def pop(self, gap: int) -> tuple[int, int]:
        return heapq.heappop(self._runs[gap])


def match_runs(counts: dict[int, int], size: int) -> list[tuple[int, int, int]]:
    """Where the pieces go: ``(first rank, first sequence, offset)``, valid up to the next one's first rank.

    Ranks number the pieces by descending length from 0.
    """
    if counts and not (1 <= min(counts) and max(counts) <= size):
        raise ValueError(f"lengths must lie between 1 and {size}")
    placed, gaps, rank, opened = [], Gaps(), 0, 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            gap = gaps.successor(length, size)
            if gap is None:
                new = -(-left // (size // length))
                gap, first, count = size, opened, new
                opened += new
            else:
                first, count = gaps.pop(gap)
            # One at a time, pieces of a length fill a sequence before they go to the next.
            most = gap // length
            for each, wide in ((most, min(left // most, count)), (left % most, int(left // most < count))):
                if each and wide:
                    placed += [(rank + k * wide, first, size - gap + k * length) for k in range(each)]
                    gaps.push(gap - each * length, first, wide)
                    rank, left, first, count = rank + each * wide, left - each * wide, first + wide, count - wide
            gaps.push(gap, first, count)
    return placed


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """``pieces`` (``doc_id, piece, length`` and more) with ``sequence_id`` and ``offset``; columns of those names are replaced."""
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    names, at_here = others(pieces, PLACES), unused(pieces, "_at")
    written = scratch.table(pieces, "pieces")
    order = [F.desc("length"), F.col("doc_id"), F.col("piece")]
    # The high bits of the row number are the partition, the low 33 the place in it.
    ranked = scratch.table(
        written.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
        .withColumn(at_here, F.monotonically_increasing_id()), "ranked")
    scratch.drop("pieces")
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = ranked.groupBy(F.shiftright(at_here, 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before = np.zeros(max([r["part"] for r in rows], default=0) + 2, np.int64)
    for r in rows:
        before[r["part"] + 1] = r["n"]
    before = np.cumsum(before)
    runs = np.array(match_runs(counts, size), np.int64).reshape(-1, 3)

    def place(rows):
        at = rows.column(at_here).to_numpy()
        rank = before[at >> 33] + (at & ((1 << 33) - 1))
        run = np.searchsorted(runs[:, 0], rank, "right") - 1
        columns = rows.columns[:-1]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(runs[run, 1] + rank - runs[run, 0]), pa.array(runs[run, 2])],
            names=[*names, "sequence_id", "offset"])

    return map_batches(ranked.select(*named([*names, at_here])), place, extended(pieces, names, PLACES))
