"""Sparse matrix-vector products and matrix checks.

Two strategies give the same numbers. ``coo`` is a join and an aggregation over
stored entries and works at any width. ``partition`` sends a dense weight vector
to every task and needs no row-level shuffle; it requires a checked width.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparselin.operators import kernels
from sparselin.schema import SCORES
from sparselin.session import MAX_BROADCAST_FEATURES, MAX_BROADCAST_ROWS, is_small, map_in_arrow

# A feature with more entries than this many mean shuffle partitions is hot.
HOT_PARTITIONS = 1.0


def to_coo(rows: DataFrame, *keep: str, outer: bool = False) -> DataFrame:
    """Stored entries ``(row_id, *keep, j, v)``; ``outer`` keeps a null entry for an empty row."""
    pairs = F.arrays_zip(F.col("indices").alias("j"), F.col("values").alias("v"))
    unnest = F.inline_outer if outer else F.inline
    return rows.select("row_id", *keep, unnest(pairs).alias("j", "v"))


def hot_features(coo: DataFrame, share: float | None = None) -> list[int]:
    """Features that hold at least ``share`` of all entries: no more than 1/share ids.

    By default a share is what a shuffle partition holds on average, so any other
    feature adds less than that to the task it meets in.
    """
    if share is None:
        share = HOT_PARTITIONS / int(coo.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = coo.where(F.col("j").isNotNull()).groupBy("j").agg(F.count("*").alias("n"))
    total = counts.select(F.sum("n")).scalar()
    return sorted(r["j"] for r in counts.where(F.col("n") >= total * share).select("j").collect())


def lookup(
    entries: DataFrame,
    weights: DataFrame,
    width: int | None = None,
    hot: Sequence[int] | None = None,
    max_broadcast: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Left join of entries with per-feature columns.

    A table within the broadcast bound is sent to the tasks. A wider one is
    shuffled, except for its hot features: those are few by definition, join by
    broadcast and so never gather in one task.
    """
    small = width <= max_broadcast if width is not None else is_small(weights, max_broadcast)
    if small:
        return entries.join(F.broadcast(weights), "j", "left")
    hot = hot_features(entries) if hot is None else hot
    is_hot = F.col("j").isin(list(hot)) if hot else F.lit(False)
    # Empty rows have a null feature; they go with the broadcast side so no task collects them.
    here = is_hot | F.col("j").isNull()
    near = entries.where(here).join(F.broadcast(weights.where(is_hot)), "j", "left")
    far = entries.where(~F.coalesce(here, F.lit(True))).join(weights.where(~is_hot), "j", "left")
    return near.unionByName(far)


def products(
    rows: DataFrame,
    vectors: DataFrame,
    columns: Sequence[str],
    width: int | None = None,
    hot: Sequence[int] | None = None,
    max_broadcast: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``(row_id, label, x·c for c in columns)`` from one pass; an empty row gives 0."""
    joined = lookup(to_coo(rows, "label", outer=True), vectors, width, hot, max_broadcast)
    # Grouped by the id alone, so that later joins on it need no further exchange.
    return joined.groupBy("row_id").agg(
        F.any_value("label").alias("label"), *(F.sum(F.coalesce(F.col("v") * F.col(c), F.lit(0.0))).alias(f"x_{c}") for c in columns))


def margins(rows: DataFrame, weights: DataFrame, width: int | None = None, **kw) -> DataFrame:
    """SCORES by the coo strategy; a feature without weight counts 0."""
    return products(rows, weights.select("j", "w"), ["w"], width, **kw).withColumnRenamed("x_w", "margin")


def _checked_dense(w: np.ndarray) -> np.ndarray:
    w = np.ascontiguousarray(w, dtype=np.float64)
    if w.size > MAX_BROADCAST_FEATURES:
        raise ValueError(f"{w.size} numbers exceed the broadcast limit of {MAX_BROADCAST_FEATURES}; use margins()")
    return w


def dense_margins(rows: DataFrame, w: np.ndarray) -> DataFrame:
    """SCORES by the partition strategy: one scan, no shuffle."""
    sent = rows.sparkSession.sparkContext.broadcast(_checked_dense(w))

    def score(batches):
        weights = sent.value
        for record_batch in batches:
            b = kernels.from_rows(record_batch)
            yield pa.RecordBatch.from_pydict({
                "row_id": record_batch.column("row_id"),
                "label": record_batch.column("label"),
                "margin": pa.array(b.dot(weights, b.owner)),
            })

    return map_in_arrow(rows.select("row_id", "label", "indices", "values"), score, SCORES)


def model_margins(rows: DataFrame, models: dict[str, np.ndarray]) -> DataFrame:
    """``(run_id, row_id, label, margin)`` of several models from one scan of the rows."""
    names = sorted(models)
    width = max(len(models[n]) for n in names)
    stacked = np.zeros((len(names), width))
    for i, n in enumerate(names):
        stacked[i, :len(models[n])] = models[n]
    _checked_dense(stacked.ravel())
    sent = rows.sparkSession.sparkContext.broadcast(stacked)

    def score(batches):
        for record_batch in batches:
            b = kernels.from_rows(record_batch)
            owner = b.owner
            for name, weights in zip(names, sent.value):
                yield pa.RecordBatch.from_pydict({
                    "run_id": pa.array([name] * record_batch.num_rows, pa.string()),
                    "row_id": record_batch.column("row_id"),
                    "label": record_batch.column("label"),
                    "margin": pa.array(b.dot(weights, owner)),
                })

    schema = "run_id string, row_id bigint, label double, margin double"
    return map_in_arrow(rows.select("row_id", "label", "indices", "values"), score, schema)


def model_counts(rows: DataFrame, models: dict[str, np.ndarray], digits: int | None = None, held: int = 1 << 20) -> DataFrame:
    """``(run_id, margin, pos, neg)`` of several models from one scan: examples by margin, counted in the tasks.

    A task ships each margin of a model once, in as many rounds as it has ``held`` margins. ``digits`` rounds margins before.
    """
    names = sorted(models)
    width = max(len(models[n]) for n in names)
    stacked = np.zeros((len(names), width))
    for i, n in enumerate(names):
        stacked[i, :len(models[n])] = models[n]
    _checked_dense(stacked.ravel())
    sent = rows.sparkSession.sparkContext.broadcast(stacked)

    def added(margin, pos, neg):
        margin, slot = np.unique(margin, return_inverse=True)
        return margin, *(np.bincount(slot, weights=x, minlength=len(margin)).astype(np.int64) for x in (pos, neg))

    def counted(counts):
        for name, (margin, pos, neg) in zip(names, counts):
            for at in range(0, len(margin), kernels.SLICE):
                some = slice(at, at + kernels.SLICE)
                yield pa.RecordBatch.from_pydict({"run_id": pa.array([name] * len(margin[some]), pa.string()), "margin": margin[some],
                                                  "pos": pa.array(pos[some]), "neg": pa.array(neg[some])})

    def count(batches):
        none = (np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
        counts = [none] * len(names)
        for record_batch in batches:
            b = kernels.from_rows(record_batch)
            owner, positive = b.owner, b.labels > 0
            for i, weights in enumerate(sent.value):
                # A sum of zeros has one sign.
                margin = b.dot(weights, owner) + 0.0
                margin = margin if digits is None else np.round(margin, digits) + 0.0
                counts[i] = added(*(np.concatenate(x) for x in zip(counts[i], (margin, positive, ~positive))))
            if sum(len(c[0]) for c in counts) > held:
                yield from counted(counts)
                counts = [none] * len(names)
        yield from counted(counts)

    parts = map_in_arrow(rows.select("label", "indices", "values"), count, "run_id string, margin double, pos bigint, neg bigint")
    return parts.groupBy("run_id", "margin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def score_models(
    rows: DataFrame, weights: DataFrame, max_broadcast: int = MAX_BROADCAST_ROWS, intercepts: DataFrame | None = None,
) -> DataFrame:
    """The same as a join, for weight tables ``(run_id, j, w)`` of any width.

    Every row gets an entry 1 of a feature -1 in which every model has its
    intercept ``(run_id, w)``, 0 without one, so each model scores each row, rows
    without any known feature included.
    """
    runs = weights.select("run_id").distinct()
    # A row of the table below holds a number of every model.
    max_broadcast //= max(1, runs.count())
    constant = F.lit(0.0)
    if intercepts is not None:
        runs, constant = runs.join(intercepts.select("run_id", "w"), "run_id", "left"), F.coalesce("w", F.lit(0.0))
    everywhere = runs.select("run_id", F.lit(-1).cast("bigint").alias("j"), constant.alias("w"))
    # As many models per feature as the sweep that made them has.
    models = weights.select("run_id", "j", "w").unionByName(everywhere).groupBy("j").agg(
        F.collect_list(F.struct("run_id", "w")).alias("models"))
    entries = to_coo(rows.withColumns({
        "indices": F.concat("indices", F.array(F.lit(-1).cast("bigint"))),
        "values": F.concat("values", F.array(F.lit(1.0))),
    }), "label")
    return (
        lookup(entries, models, max_broadcast=max_broadcast)
        .select("row_id", "label", "v", F.inline("models"))
        .groupBy("run_id", "row_id", "label").agg(F.sum(F.col("v") * F.col("w")).alias("margin"))
    )


def transposed(rows: DataFrame, r: Column) -> DataFrame:
    """``Xᵀ r`` as ``(j, z)`` with ``r`` an expression over the row's own columns.

    The residual travels with its row, so nothing but the partial sums per
    feature is shuffled.
    """
    weighted = rows.withColumn("_r", r).where(F.col("_r") != 0)
    return to_coo(weighted, "_r").groupBy("j").agg(F.sum(F.col("v") * F.col("_r")).alias("z"))


def transposed_by_id(rows: DataFrame, r: DataFrame) -> DataFrame:
    """``Xᵀ r`` for a residual table ``(row_id, r)`` that lives apart from the rows.

    Whole rows meet their residual, and their entries are unnested after that.
    """
    met = rows.select("row_id", "indices", "values").join(r.where(F.col("r") != 0).select("row_id", "r"), "row_id")
    return to_coo(met, "r").groupBy("j").agg(F.sum(F.col("v") * F.col("r")).alias("z"))


def signed_margin_sum(scores: DataFrame) -> DataFrame:
    return scores.agg(F.sum(F.col("label") * F.col("margin")).alias("signed_sum"))


def signed_margin_sum_partition(rows: DataFrame, w: np.ndarray) -> DataFrame:
    """The same total with one partial sum per task."""
    sent = rows.sparkSession.sparkContext.broadcast(_checked_dense(w))

    def partial(batches):
        total = 0.0
        for record_batch in batches:
            b = kernels.from_rows(record_batch)
            total += float(b.labels @ b.dot(sent.value, b.owner))
        yield pa.RecordBatch.from_pydict({"s": pa.array([total])})

    parts = map_in_arrow(rows.select("label", "indices", "values"), partial, "s double")
    return parts.agg(F.sum("s").alias("signed_sum"))


def matrix_profile(rows: DataFrame) -> DataFrame:
    """Rows, columns, stored entries, and the range of entries per row."""
    size = F.size("indices")
    return rows.agg(
        F.count("*").alias("n_rows"),
        (F.coalesce(F.max(F.array_max("indices")), F.lit(-1)) + 1).alias("n_cols"),
        F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("nnz"),
        F.min(size).cast("bigint").alias("min_row_nnz"),
        F.max(size).cast("bigint").alias("max_row_nnz"),
        F.count_if(size == 0).alias("empty_rows"),
    )


def label_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def violations(rows: DataFrame, n_features: int, weights: DataFrame | None = None) -> DataFrame:
    """Counts of structural faults in one aggregate: all zero for a sound matrix."""
    checks = [
        F.count_if(F.size("indices") != F.size("values")).alias("length_mismatch"),
        F.count_if(F.exists("indices", lambda j: (j < 0) | (j >= n_features))).alias("out_of_range"),
        F.count_if(F.size(F.array_distinct("indices")) != F.size("indices")).alias("repeated_index"),
        F.count_if(F.col("label").isNull()).alias("missing_label"),
    ]
    if weights is not None:
        width = weights.agg(F.coalesce(F.max("j"), F.lit(-1)) + 1).scalar()
        checks.append((F.max(width) != n_features).cast("bigint").alias("weight_width_mismatch"))
    return rows.agg(*checks)


def check(rows: DataFrame, n_features: int, weights: DataFrame | None = None) -> None:
    """Raise if ``violations`` finds any."""
    found = {k: v for k, v in violations(rows, n_features, weights).first().asDict().items() if v}
    if found:
        raise ValueError(f"malformed examples: {found}")


