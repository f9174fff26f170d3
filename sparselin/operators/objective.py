"""f(w) = ½‖w‖² + C Σ loss(x·w, y): value, gradient and Hessian-vector product as Spark jobs.

Functions of a DataFrame of rows compute within the rows where the weights fit a
broadcast, and exchange slices of sums only; wider weights are joined (``coo``).
``Blocks`` is the partition strategy for repeated passes: rows are packed once
into persisted byte blocks and every pass is a single job over them.

A task adds up in NumPy and gives one record for each range of features, and the
records of a range are added by one task, over tasks of ``FAN`` records each where
there are more. A feature that does not fit the stated width is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparselin.functions.losses import Loss, get_loss
from sparselin.operators import kernels
from sparselin.operators.matvec import products, to_coo
from sparselin.session import MAX_BROADCAST_FEATURES, map_in_arrow
from sparselin.sources import weights as W

# Fixed value: the id a scalar travels under, below all feature ids.
LOSS_ID = -1
# Records of one range that a task adds up.
FAN = 64
# Bytes of slices that the driver adds up itself.
DIRECT_BYTES = 16 << 20
# Bytes of packed blocks for a task, where the number of cores is not known beforehand.
TASK_BYTES = 128 << 20

# ---------------------------------------------------------------- coo strategy


def _loss(loss: Loss | str) -> Loss:
    return get_loss(loss) if isinstance(loss, str) else loss


def _row_local(width: int | None, strategy: str) -> bool:
    if strategy not in ("auto", "coo"):
        raise ValueError(f"unknown strategy {strategy!r}; known: auto, coo")
    return strategy == "auto" and width is not None and width <= MAX_BROADCAST_FEATURES


def within(rows: DataFrame, width: int | None) -> DataFrame:
    """The rows, of which one with a feature beyond ``width`` raises an error in whatever reads them."""
    if width is None:
        return rows
    fits = F.coalesce(F.array_max("indices"), F.lit(-1)) < width
    return rows.withColumn("indices", F.when(fits, F.col("indices")).otherwise(
        F.raise_error(F.lit(f"a feature does not fit into {width} columns"))))


def added(slices: DataFrame, tasks: int, length: int) -> DataFrame:
    """``part, z``: the slices of ``tasks`` tasks, added by range. One record of a range stays."""
    ranges = max(1, -(-length // kernels.SLICE))
    if tasks > FAN:
        groups = -(-tasks // FAN)
        slices = map_in_arrow(slices.withColumn("_g", F.spark_partition_id() % groups).repartition(ranges * groups, "part", "_g").drop("_g"),
                              kernels.add_slices, kernels.SLICES)
    return map_in_arrow(slices.repartition(ranges, "part"), kernels.add_slices, kernels.SLICES)


def _partial_sums(rows: DataFrame, loss: Loss, kind: str, w: np.ndarray, s: np.ndarray | None = None) -> DataFrame:
    """``(j, z)``: Xᵀ residual (``slope``) or Xᵀ D X s (``product``); Σ loss under ``LOSS_ID`` (``loss``), by task."""
    sent = rows.sparkSession.sparkContext.broadcast((w, s))
    rows, size = within(rows, len(w)), kernels.SLICE

    def task(batches):
        weights, direction = sent.value
        total, out = 0.0, np.zeros(0 if kind == "loss" else len(weights))
        for record_batch in batches:
            b = kernels.from_rows(record_batch)
            owner = b.owner
            m = b.dot(weights, owner)
            if kind == "loss":
                total += float(loss.value(m, b.labels, np).sum())
            elif kind == "slope":
                b.add_transposed(loss.residual(m, b.labels, np), owner, out)
            else:
                b.add_transposed(loss.curvature(m, b.labels, np) * b.dot(direction, owner), owner, out)
        if kind == "loss":
            yield pa.RecordBatch.from_pydict({"j": pa.array([LOSS_ID], pa.int64()), "z": [total]})
        else:
            yield from kernels.slices_of(out, size)

    given = rows.select("label", "indices", "values")
    if kind == "loss":
        return map_in_arrow(given, task, "j bigint, z double")

    def entries(batches):
        for batch in kernels.add_slices(batches):
            z = np.frombuffer(batch.column("z")[0].as_buffer())
            found = np.flatnonzero(z)
            yield pa.RecordBatch.from_pydict({"j": pa.array(found + batch.column("part")[0].as_py() * size), "z": pa.array(z[found])})

    ranges = max(1, -(-len(w) // kernels.SLICE))
    slices = map_in_arrow(given, task, kernels.SLICES)
    if (tasks := given.rdd.getNumPartitions()) > FAN:
        slices = added(slices, tasks, len(w))
    return map_in_arrow(slices.repartition(ranges, "part"), entries, "j bigint, z double")


def _with_vector(vector: DataFrame, column: str, parts: DataFrame, C: float, name: str) -> DataFrame:
    """``vector + C Σ parts``: both meet in one aggregation."""
    both = vector.select("j", F.col(column).alias("z")).unionByName(parts.select("j", (C * F.col("z")).alias("z")))
    return both.groupBy("j").agg(F.sum("z").alias(name))


def objective(rows: DataFrame, weights: DataFrame, loss: Loss | str, C: float, width: int | None = None,
              strategy: str = "auto", **kw) -> DataFrame:
    """One row ``f``."""
    loss = _loss(loss)
    if _row_local(width, strategy):
        w = W.to_array(weights, width)
        total = F.coalesce(F.sum("z"), F.lit(0.0))
        return _partial_sums(rows, loss, "loss", w).agg((0.5 * float(w @ w) + C * total).alias("f"))
    m = products(within(rows, width), weights.select("j", "w"), ["w"], width, **kw)
    penalty = weights.agg(F.coalesce(F.sum(F.col("w") * F.col("w")), F.lit(0.0)) / 2).scalar()
    total = F.coalesce(F.sum(loss.value(F.col("x_w"), F.col("label"))), F.lit(0.0))
    return m.agg((F.max(penalty) + C * total).alias("f"))


def _back_to_features(rows: DataFrame, per_row: DataFrame) -> DataFrame:
    """Σ v·r per feature for a per-row column ``r``; both sides are keyed by ``row_id``."""
    weighted = rows.select("row_id", "indices", "values").join(
        per_row.where(F.col("r") != 0).select("row_id", "r"), "row_id")
    return to_coo(weighted, "r").groupBy("j").agg(F.sum(F.col("v") * F.col("r")).alias("z"))


def _plus_vector(vector: DataFrame, column: str, z: DataFrame, C: float, name: str) -> DataFrame:
    """``vector + C z`` over the features of either side."""
    both = vector.select("j", F.col(column).alias("_a")).join(z, "j", "full_outer")
    return both.select("j", (F.coalesce("_a", F.lit(0.0)) + C * F.coalesce("z", F.lit(0.0))).alias(name))


def gradient(rows: DataFrame, weights: DataFrame, loss: Loss | str, C: float, width: int | None = None,
             strategy: str = "auto", **kw) -> DataFrame:
    """``(j, g)``."""
    loss = _loss(loss)
    if _row_local(width, strategy):
        return _with_vector(weights, "w", _partial_sums(rows, loss, "slope", W.to_array(weights, width)), C, "g")
    rows = within(rows, width)
    m = products(rows, weights.select("j", "w"), ["w"], width, **kw)
    per_row = m.select("row_id", loss.residual(F.col("x_w"), F.col("label")).alias("r"))
    return _plus_vector(weights, "w", _back_to_features(rows, per_row), C, "g")


def loss_and_slope(rows: DataFrame, weights: DataFrame, loss: Loss | str, width: int | None = None, **kw) -> DataFrame:
    """``(j, z)``: Xᵀ residual, and Σ loss under the id ``LOSS_ID``, from one evaluation of the margins."""
    loss = _loss(loss)
    m = products(rows, weights.select("j", "w"), ["w"], width, **kw)
    y, x = F.col("label"), F.col("x_w")
    per_row = m.select("row_id", loss.value(x, y).alias("loss"), loss.residual(x, y).alias("r"))
    located = rows.select("row_id", "indices", "values").join(per_row, "row_id")
    pairs = F.concat(
        F.array(F.struct(F.lit(LOSS_ID).cast("bigint").alias("j"), F.col("loss").alias("v"))),
        F.zip_with("indices", "values", lambda j, v: F.struct(j.alias("j"), (v * F.col("r")).alias("v"))),
    )
    return located.select(F.inline(pairs).alias("j", "v")).groupBy("j").agg(F.sum("v").alias("z"))


def curvature_product(rows: DataFrame, vectors: DataFrame, loss: Loss | str, width: int | None = None, **kw) -> DataFrame:
    """``(j, z)``: Xᵀ D X s for a table ``(j, w, s)``; x·w and x·s come from the same join."""
    loss = _loss(loss)
    rows = within(rows, width)
    m = products(rows, vectors.select("j", "w", "s"), ["w", "s"], width, **kw)
    bent = loss.curvature(F.col("x_w"), F.col("label")) * F.col("x_s")
    return _back_to_features(rows, m.select("row_id", bent.alias("r")))


def hessian_vector(rows: DataFrame, vectors: DataFrame, loss: Loss | str, C: float, width: int | None = None,
                   strategy: str = "auto", **kw) -> DataFrame:
    """``(j, h)`` for a table ``(j, w, s)``."""
    if _row_local(width, strategy):
        w, s = (W.to_array(vectors, width, c) for c in ("w", "s"))
        return _with_vector(vectors, "s", _partial_sums(rows, _loss(loss), "product", w, s), C, "h")
    return _plus_vector(vectors, "s", curvature_product(rows, vectors, loss, width, **kw), C, "h")


# ---------------------------------------------------------- partition strategy


class Blocks:
    """Examples packed for repeated passes, and the passes themselves.

    Every pass is one job that returns sums of feature length. A task takes several
    packed partitions if there are more of them than needed, so the partial sums
    follow the cores.
    """

    def __init__(
        self, rows: DataFrame, n_features: int | None = None, storage: StorageLevel = StorageLevel.MEMORY_AND_DISK,
        any_width: bool = False,
    ):
        """Without ``n_features`` the width is the largest id in the blocks + 1, so the rows are still read once.

        With ``any_width`` one beyond the dense limit is no error yet: ``n_features`` tells it, for another strategy.
        """
        self.spark = rows.sparkSession
        packed = map_in_arrow(within(rows, n_features).select("label", "indices", "values"), kernels.pack, kernels.BLOCK_SCHEMA)
        self.blocks = packed.persist(storage)
        self._filled = False
        cores = 2 * self.spark.sparkContext.defaultParallelism
        self._tasks = max(1, cores)
        flexible = self.spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false") == "true"
        if n_features is None or flexible:
            found = self._figures()
            if n_features is None:
                if found["top"] is None:
                    self.close()
                    raise ValueError("no usable examples")
                n_features = found["top"] + 1
            if flexible:
                # The executors of now say nothing about those of later passes; idle blocks are not worth a task each.
                self._tasks = max(self._tasks, -(-found["size"] // TASK_BYTES))
        if n_features > MAX_BROADCAST_FEATURES and not any_width:
            self.close()
            raise ValueError(f"{n_features} features exceed the dense limit of {MAX_BROADCAST_FEATURES}")
        self.n_features = n_features

    def _figures(self) -> dict:
        size = F.length("labels") + F.length("offsets") + F.length("indices") + F.length("vals")
        found = self.blocks.agg(F.max("top").alias("top"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("size")).first().asDict()
        self._filled = True
        return found

    def __enter__(self) -> Blocks:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        self.blocks.unpersist()

    def slices(self, task) -> DataFrame:
        """What ``task`` gives for the packed blocks: a record for each task and range."""
        # A first pass that also packs would keep a Python worker for either beside that of the rows, and workers live on.
        if not self._filled:
            self.blocks.count()
            self._filled = True
        return map_in_arrow(self.blocks.drop("top").coalesce(self._tasks), task, kernels.SLICES)

    def _sums(self, add, sent, length: int) -> np.ndarray:
        """The sums of all tasks. ``add(sent value, batch, out)`` adds those of a packed batch to ``out``."""
        size = kernels.SLICE

        def task(batches):
            out = np.zeros(length)
            for record_batch in batches:
                for b in kernels.from_blocks(record_batch):
                    add(sent.value, b, out)
            yield from kernels.slices_of(out, size)

        slices = self.slices(task)
        # A few short slices are added here, without another stage.
        if 8 * length * self._tasks > DIRECT_BYTES:
            slices = added(slices, self._tasks, length)
        try:
            found = slices.toArrow()
        finally:
            sent.destroy()
        total = np.zeros(length)
        for batch in kernels.add_slices(found.to_batches()):
            at = batch.column("part")[0].as_py() * size
            z = np.frombuffer(batch.column("z")[0].as_buffer())
            total[at:at + len(z)] = z
        return total

    def loss_and_slope(self, loss: Loss, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Σ loss and Xᵀ residual from one job."""
        return self._answers([(loss, "value", w)])[0]

    def curvature_product(self, loss: Loss, w: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Xᵀ D X s from one job."""
        return self._answers([(loss, "product", w, s)])[0]

    def answers(self, requests: Sequence[tuple]) -> list:
        """Several ``(loss, "value", w)`` and ``(loss, "product", w, s)`` from one job, as long as they fit a broadcast.

        A value request gives Σ loss and Xᵀ residual, a product request Xᵀ D X s.
        """
        size = max(1, MAX_BROADCAST_FEATURES // (2 * (self.n_features + 1)))
        return [x for i in range(0, len(requests), size) for x in self._answers(requests[i:i + size])]

    def _answers(self, requests: Sequence[tuple]) -> list:
        stride = self.n_features + 1
        asked = [(loss, kind) for loss, kind, *_ in requests]
        sent = self.spark.sparkContext.broadcast([vectors for _, _, *vectors in requests])

        def add(vectors, b, out):
            owner = b.owner
            # A model's sums, its loss behind them, then the next model's.
            for (loss, kind), (w, *s), sums in zip(asked, vectors, out.reshape(-1, stride)):
                m = b.dot(w, owner)
                if kind == "value":
                    sums[-1] += float(loss.value(m, b.labels, np).sum())
                    r = loss.residual(m, b.labels, np)
                else:
                    r = loss.curvature(m, b.labels, np) * b.dot(s[0], owner)
                b.add_transposed(r, owner, sums[:-1])

        sums = self._sums(add, sent, len(requests) * stride).reshape(-1, stride)
        return [(float(x[-1]), x[:-1]) if kind == "value" else x[:-1] for x, (_, kind, *_) in zip(sums, requests)]

    def losses_at(self, loss: Loss, models: Sequence[np.ndarray]) -> list[float]:
        """Σ loss at several weight vectors: one job for as many as fit one broadcast."""
        size = max(1, MAX_BROADCAST_FEATURES // max(1, self.n_features))
        if len(models) > size:
            return [x for i in range(0, len(models), size) for x in self.losses_at(loss, models[i:i + size])]
        sent = self.spark.sparkContext.broadcast(np.stack(models))

        def add(stacked, b, out):
            owner = b.owner
            for i, weights in enumerate(stacked):
                out[i] += float(loss.value(b.dot(weights, owner), b.labels, np).sum())

        return self._sums(add, sent, len(models)).tolist()
