"""Examples as a grid of row blocks and feature ranges, for weights no task can hold.

Rows are cut once. A piece holds the entries of a block of rows in one range of ``SPAN`` features. Pieces of a range are
dealt to cells of about ``CELL_BYTES``, so a range that has many entries, a bias included, spreads over several, and
are kept partitioned and sorted by cell. Vectors are tables of ``SLICES``, several told apart by the number ``ask``. A pass sends
their slices to the cells, the partial margins to the row blocks, and what the loss makes of the margins back to the cells,
for the rows a piece has; the sums of the cells meet by range. Entries are never exchanged after the cut. One pass serves
several vectors.
"""

from __future__ import annotations

import weakref
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparselin.functions.losses import Loss
from sparselin.operators import kernels
from sparselin.schema import SCORES
from sparselin.session import keep, map_in_arrow, materialize, scratch_path, ship_package

# Features of a range: a slice of 512 KiB.
SPAN = 1 << 16
# Bytes of the pieces a task holds at once.
CELL_BYTES = 32 << 20
# Vectors of a pass: a cell gets a slice of each.
VECTORS = 32
# Loss totals of row blocks meet in so many groups first.
TOTALS = 256
# Spans of what is no slice of a vector: the rows of a block, and sums of losses.
HEAD = -1

PIECES = "block long, span int, rows binary, owner binary, j binary, v binary"
SLICES = "ask int, span int, x binary, square double, largest double, dot double"
TERMS = ("ask", "span", "scale", "x", "partner")


def cut(batches, span: int):
    """The rows of each batch as a block: its ids and labels, then its pieces by range."""
    part = TaskContext.get().partitionId()
    for k, record_batch in enumerate(batches):
        b = kernels.from_rows(record_batch)
        if not len(b.labels):
            continue
        block = part << 33 | k
        rows = [(block, HEAD, record_batch.column("row_id").to_numpy().tobytes(), b"", b"", b.labels.tobytes())]
        area = b.indices // span
        order = np.argsort(area, kind="stable")
        area, owner, j, v = area[order], b.owner[order], b.indices[order] % span, b.values[order]
        edges = np.flatnonzero(np.diff(area, prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            touched, place = np.unique(owner[lo:hi], return_inverse=True)
            rows.append((block, int(area[lo]), touched.astype(np.int32).tobytes(), place.astype(np.int32).tobytes(),
                         j[lo:hi].astype(np.int32).tobytes(), v[lo:hi].tobytes()))
        for row in rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.int32()), *(pa.array([x], pa.binary()) for x in row[2:])],
                names=["block", "span", "rows", "owner", "j", "v"])


def numbers(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def sliced(vector: DataFrame, span: int, column: str = "w", ask: str | None = None) -> DataFrame:
    """``SLICES`` of a vector ``(j, column)``, or of several told apart by the number ``ask``; repeated ids are added."""
    placed = vector.select(
        (F.col(ask) if ask else F.lit(0)).cast("int").alias("ask"), F.floor(F.col("j") / span).cast("int").alias("span"),
        (F.col("j") % span).cast("int").alias("at"), F.col(column).alias("x"))

    def task(batches):
        for (ask_, part), table in grouped(batches, ("ask", "span")):
            x = np.bincount(table.column("at").to_numpy(), weights=table.column("x").to_numpy(), minlength=span)
            yield slice_row(ask_, part, x)

    return map_in_arrow(placed.repartition("ask", "span").sortWithinPartitions("ask", "span"), task, SLICES)


def unsliced(slices: DataFrame, span: int, column: str = "w") -> DataFrame:
    """``(ask, j, column)`` of slices, without zeros."""
    def task(batches):
        for batch in batches:
            for ask, part, x in zip(*(batch.column(c) for c in ("ask", "span", "x"))):
                x = np.frombuffer(x.as_buffer())
                found = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), ask.as_py(), np.int32)), pa.array(found + part.as_py() * span), pa.array(x[found])],
                    names=["ask", "j", column])

    return map_in_arrow(slices.select("ask", "span", "x"), task, f"ask int, j bigint, {column} double")


def slice_row(ask: int, span: int, x: np.ndarray, dot: float = 0.0) -> pa.RecordBatch:
    """A slice with Σ x², max |x| and an inner product."""
    return pa.RecordBatch.from_arrays(
        [pa.array([ask], pa.int32()), pa.array([span], pa.int32()), pa.array([x.tobytes()], pa.binary()),
         pa.array([float(x @ x)]), pa.array([float(np.abs(x).max(initial=0.0))]), pa.array([float(dot)])],
        names=["ask", "span", "x", "square", "largest", "dot"])


def grouped(batches, keys: Sequence[str]):
    """``(key, table)`` of consecutive records with equal keys."""
    held, held_key = [], None
    for batch in batches:
        values = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        start = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[start]:
                if values[start] != held_key and held:
                    yield held_key, pa.Table.from_batches(held)
                    held = []
                held_key = values[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield held_key, pa.Table.from_batches(held)


def weighted_sums(terms: DataFrame) -> DataFrame:
    """``SLICES``: Σ scale · x over the ``TERMS`` of each slice.

    ``dot`` is the inner product of the sum and the term marked as ``partner``, if any; of span ``HEAD`` the sum itself.
    """
    def made(key, total, partner):
        return slice_row(*key, total, total[0] if key[1] == HEAD else 0.0 if partner is None else total @ partner)

    def task(batches):
        held, total, partner = None, None, None
        for batch in batches:
            for key, scale, x, is_partner in zip(zip(batch.column("ask").to_pylist(), batch.column("span").to_pylist()),
                                                 batch.column("scale").to_pylist(), batch.column("x"), batch.column("partner").to_pylist()):
                x = np.frombuffer(x.as_buffer())
                if key == held:
                    total += scale * x
                else:
                    if held is not None:
                        yield made(held, total, partner)
                    held, total, partner = key, scale * x, None
                partner = x if is_partner else partner
        if held is not None:
            yield made(held, total, partner)

    keyed = terms.select(*TERMS).repartition("ask", "span").sortWithinPartitions("ask", "span")
    return map_in_arrow(keyed, task, SLICES)


def inner_products(pairs: DataFrame) -> DataFrame:
    """``ask, dot`` of records ``(ask, span, x)``, two where both vectors of a pair have the slice; one alone adds nothing."""
    def task(batches):
        for (ask, _), table in grouped(batches, ("ask", "span")):
            if table.num_rows == 2:
                a, b = numbers(table.column("x"), np.float64)
                yield pa.RecordBatch.from_pydict({"ask": pa.array([ask], pa.int32()), "dot": [float(a @ b)]})

    keyed = pairs.repartition("ask", "span").sortWithinPartitions("ask", "span")
    return map_in_arrow(keyed, task, "ask int, dot double").groupBy("ask").agg(F.sum("dot").alias("dot"))


def _forget(spark, *frames: DataFrame) -> None:
    if spark.sparkContext._jsc is not None:
        for frame in frames:
            frame.unpersist()


def wide_margins(rows: DataFrame, vectors: DataFrame, n_features: int, asks: int = 1, span: int | None = None) -> DataFrame:
    """``ask`` and SCORES by vectors ``(ask, j, w)`` of any width, ``asks`` of them; without ``ask`` there is one."""
    grid = Grid(rows, n_features, span)
    parts = []
    for low in range(0, asks, VECTORS):
        some = vectors if "ask" not in vectors.columns else vectors.where((F.col("ask") >= low) & (F.col("ask") < low + VECTORS)).withColumn("ask", F.col("ask") - low)
        slices = sliced(some, grid.span, ask="ask" if "ask" in vectors.columns else None)
        parts.append(grid.margins(slices, min(VECTORS, asks - low)).withColumn("ask", F.col("ask") + low))
    scores = reduce(DataFrame.unionAll, parts)
    # The caches live as long as the result.
    scores._grid = grid
    return scores


class Grid:
    """The cut rows, and passes over them. ``span`` is the range width in use."""

    def __init__(self, rows: DataFrame, n_features: int, span: int | None = None, cell_bytes: int | None = None):
        self.spark = spark = rows.sparkSession
        ship_package(spark)
        self.n_features, self.span = n_features, span or SPAN
        width = self.span
        pieces = rows.select("row_id", "label", "indices", "values").mapInArrow(lambda batches: cut(batches, width), PIECES)
        self._written = materialize(pieces, scratch_path(spark, "grid"))
        size = (F.length("owner") + F.length("j") + F.length("v")).cast("long")
        sizes = self._written.where(F.col("span") >= 0).groupBy("span").agg(F.sum(size).alias("size"))
        limit = cell_bytes or CELL_BYTES
        # One row a range that has entries; a range is dealt to so many cells.
        self.cells = materialize(sizes.select("span", "size", F.ceil(F.col("size") / limit).cast("int").alias("salts")), scratch_path(spark, "grid-cells"))
        found = self.cells.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("salts"), F.lit(0)).alias("cells")).first()
        n_blocks = self._written.where(F.col("span") == HEAD).count()
        # Some cells a partition, but no more partitions than there are cells, or blocks.
        most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found["size"] // (4 * limit)))
        n, n_by_block = max(1, min(most, found["cells"])), max(1, min(most, n_blocks))
        salted = self._written.where(F.col("span") >= 0).join(self.cells.select("span", "salts"), "span").withColumn(
            "salt", F.pmod(F.xxhash64("block"), F.col("salts")).cast("int"))
        columns = ["span", "salt", "block", "rows", "owner", "j", "v"]
        self.pieces = keep(salted.select(*columns).repartition(n, "span", "salt").sortWithinPartitions("span", "salt"))
        heads = self._written.where(F.col("span") == HEAD).select("block", F.lit(HEAD).alias("span"), F.lit(0).alias("salt"), "rows", "v")
        links = salted.select("block", "span", "salt", "rows", F.lit(None).cast("binary").alias("v"))
        self.blocks = keep(heads.unionAll(links).repartition(n_by_block, "block").sortWithinPartitions("block"))

        # Results are lazy, so the caches go with the grid; what still reads them cuts from the written pieces again.
        weakref.finalize(self, _forget, spark, self.pieces, self.blocks).atexit = False

    def __enter__(self) -> Grid:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        _forget(self.spark, self.pieces, self.blocks)

    def _partial_margins(self, vectors: DataFrame) -> DataFrame:
        """``block, ask, rows, m`` of every piece and vector of its range."""
        def task(left, right):
            asks, xs = right.column("ask").to_pylist(), numbers(right.column("x"), np.float64)
            out = {"block": [], "ask": [], "rows": [], "m": []}
            pieces = zip(left.column("block").to_pylist(), left.column("rows"), *(numbers(left.column(c), k) for c, k in (("owner", np.int32), ("j", np.int32), ("v", np.float64))))
            for block, rows, owner, j, v in pieces:
                rows = rows.as_py()
                for ask, x in zip(asks, xs):
                    out["block"].append(block)
                    out["ask"].append(ask)
                    out["rows"].append(rows)
                    out["m"].append(np.bincount(owner, weights=v * x[j], minlength=len(rows) // 4).tobytes())
            return pa.table(out, schema=pa.schema([("block", pa.int64()), ("ask", pa.int32()), ("rows", pa.binary()), ("m", pa.binary())]))

        spread = vectors.select("ask", "span", "x").join(self.cells.select("span", "salts"), "span").select(
            "span", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "ask", "x")
        return self.pieces.groupBy("span", "salt").cogroup(spread.groupBy("span", "salt")).applyInArrow(
            task, "block long, ask int, rows binary, m binary")

    def _by_block(self, vectors: DataFrame, asks: int, use, schema: str) -> DataFrame:
        """``use(block, margins, head, links)`` for every row block, with the margins of all ``asks`` vectors.

        ``head`` are the ids and labels of its rows, ``links`` the ``(span, salt, rows)`` of its pieces.
        """
        def task(left, right):
            spans = left.column("span").to_pylist()
            at = spans.index(HEAD)
            ids, labels = np.frombuffer(left.column("rows")[at].as_buffer(), np.int64), np.frombuffer(left.column("v")[at].as_buffer())
            margins = np.zeros((asks, len(labels)))
            for ask, rows, m in zip(right.column("ask").to_pylist(), numbers(right.column("rows"), np.int32), numbers(right.column("m"), np.float64)):
                margins[ask, rows] += m
            links = [(s, t, np.frombuffer(r.as_buffer(), np.int32)) for s, t, r in
                     zip(spans, left.column("salt").to_pylist(), left.column("rows")) if s != HEAD]
            return use(left.column("block")[0].as_py(), margins, (ids, labels), links)

        return self.blocks.groupBy("block").cogroup(self._partial_margins(vectors).groupBy("block")).applyInArrow(task, schema)

    def margins(self, vectors: DataFrame, asks: int = 1) -> DataFrame:
        """``ask`` and SCORES of every row and vector."""
        def use(block, margins, head, links):
            ids, labels = head
            return pa.table({"ask": pa.array(np.repeat(np.arange(asks, dtype=np.int32), len(ids))), "row_id": np.tile(ids, asks),
                             "label": np.tile(labels, asks), "margin": margins.ravel()})

        return self._by_block(vectors, asks, use, "ask int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCORES.fields))

    def sums(self, vectors: DataFrame, requests: Sequence[tuple[Loss, str]], scales: Sequence[float] | None = None,
             more: DataFrame | None = None) -> DataFrame:
        """``SLICES`` of what a pass gives for each request, and Σ loss as the first number of span ``HEAD``.

        Request k is a loss and ``value`` (Xᵀ residual), ``loss`` (no slices) or ``product`` (Xᵀ D X s). Its vector w has
        the number 2 k in ``vectors``, its direction s the number 2 k + 1. The slices are multiplied by ``scales[k]``,
        and the ``TERMS`` of ``more`` added.
        """
        factors = [1.0] * len(requests) if scales is None else [float(x) for x in scales]
        asked = list(requests)

        def use(block, margins, head, links):
            y, out = head[1], []
            for k, (loss, kind) in enumerate(asked):
                m = margins[2 * k]
                if kind == "product":
                    r = loss.curvature(m, y, np) * margins[2 * k + 1]
                else:
                    out.append((HEAD, block % TOTALS, block, k, np.array([loss.value(m, y, np).sum()]).tobytes()))
                    r = loss.residual(m, y, np) if kind == "value" else None
                if r is not None:
                    out += [(span, salt, block, k, r[rows].tobytes()) for span, salt, rows in links]
            kinds = (("span", pa.int32()), ("salt", pa.int32()), ("block", pa.int64()), ("ask", pa.int32()), ("r", pa.binary()))
            return pa.table([pa.array(x, t) for x, (_, t) in zip(list(zip(*out)) or [[]] * 5, kinds)], names=[n for n, _ in kinds])

        bent = self._by_block(vectors, 2 * len(asked), use, "span int, salt int, block long, ask int, r binary")
        width = self.span

        def back(left, right):
            piece = {b: x for b, *x in zip(left.column("block").to_pylist(), *(numbers(left.column(c), k) for c, k in (("owner", np.int32), ("j", np.int32), ("v", np.float64))))}
            totals, span = {}, right.column("span")[0].as_py() if right.num_rows else HEAD
            for block, ask, r in zip(right.column("block").to_pylist(), right.column("ask").to_pylist(), numbers(right.column("r"), np.float64)):
                if span != HEAD:
                    owner, j, v = piece[block]
                    r = np.bincount(j, weights=v * r[owner], minlength=width)
                totals[ask] = totals[ask] + r if ask in totals else r
            return pa.table({"ask": pa.array(list(totals), pa.int32()), "span": pa.array([span] * len(totals), pa.int32()),
                             "scale": pa.array([1.0 if span == HEAD else factors[k] for k in totals], pa.float64()), "x": pa.array([z.tobytes() for z in totals.values()], pa.binary())})

        cells = self.pieces.groupBy("span", "salt").cogroup(bent.groupBy("span", "salt")).applyInArrow(
            back, "ask int, span int, scale double, x binary").withColumn("partner", F.lit(False))
        return weighted_sums(cells if more is None else cells.unionAll(more.select(*TERMS)))

    def losses(self, vectors: DataFrame, loss: Loss, asks: int) -> list[float]:
        """Σ loss at the vectors with the numbers 0 to ``asks - 1``."""
        out = []
        for low in range(0, asks, VECTORS):
            some = vectors.where((F.col("ask") >= low) & (F.col("ask") < low + VECTORS)).withColumn("ask", 2 * (F.col("ask") - low))
            n = min(VECTORS, asks - low)
            found = {r["ask"]: np.frombuffer(r["x"])[0] for r in self.sums(some, [(loss, "loss")] * n).collect()}
            out += [float(found.get(k, 0.0)) for k in range(n)]
        return out
