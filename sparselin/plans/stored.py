"""Accuracy and AUC by configuration from stored runs: logs, weights and thresholds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparselin.operators import metrics
from sparselin.operators.matvec import model_counts, score_models
from sparselin.plans import reports
from sparselin.plans.evaluate import summarize_counts
from sparselin.session import MAX_BROADCAST_FEATURES


def run_models(runs: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights ``(run_id, j, w)`` and intercepts ``(run_id, w)`` of runs ``(run_id, weights_id, bias)``.

    ``weights`` is ``(weights_id, j, w)``, with ``n_features`` if stored. A run with a
    bias has its weight in the last feature of its own width, whatever the other
    runs have; it becomes an intercept, since examples carry no bias here.
    """
    last = F.max("j")
    if "n_features" in weights.columns:
        last = F.greatest(last, F.max("n_features") - 1)
    ends = weights.groupBy("weights_id").agg(last.alias("_last"))
    known = runs.select("run_id", "weights_id", "bias").join(ends, "weights_id").join(
        weights.select("weights_id", "j", "w"), "weights_id")
    is_bias = (F.col("bias") >= 0) & (F.col("j") == F.col("_last"))
    # A model without weights scores 0.
    nothing = runs.select("run_id", F.lit(0).cast("bigint").alias("j"), F.lit(0.0).alias("w"))
    return (known.where(~is_bias).select("run_id", "j", "w").unionByName(nothing),
            known.where(is_bias).select("run_id", (F.col("bias") * F.col("w")).alias("w")))


def counted(rows: DataFrame, models: DataFrame, intercepts: DataFrame, digits: int | None, max_dense: int) -> DataFrame:
    """``(run_id, margin, pos, neg)`` of all models; those that take no more than ``max_dense`` numbers are counted in the tasks."""
    size = models.agg(F.count_distinct("run_id").alias("n"), (F.coalesce(F.max("j"), F.lit(-1)) + 1).alias("width")).first()
    if size["n"] * (size["width"] + 1) > max_dense:
        scores = score_models(rows, models, intercepts=intercepts)
        if digits is not None:
            scores = scores.withColumn("margin", F.round("margin", digits) + F.lit(0.0))
        return metrics.score_counts(scores, ["run_id"])
    width = size["width"]
    found = models.select("run_id", "j", "w").unionByName(intercepts.select("run_id", F.lit(width).cast("bigint").alias("j"), "w")).toArrow()
    arrays: dict[str, np.ndarray] = {}
    for name, j, w in zip(found["run_id"].to_pylist(), found["j"].to_pylist(), found["w"].to_pylist()):
        arrays.setdefault(name, np.zeros(width + 1))[j] += w
    # An example's features without weight in any model give way to the constant behind the last one that has some.
    known = F.filter(F.arrays_zip("indices", "values"), lambda p: p["indices"] < width)
    biased = rows.select("row_id", "label", known.alias("_known")).select(
        "row_id", "label", F.concat(F.col("_known.indices"), F.array(F.lit(width).cast("bigint"))).alias("indices"),
        F.concat(F.col("_known.values"), F.array(F.lit(1.0))).alias("values"))
    return model_counts(biased, arrays, digits)


def report(
    rows: DataFrame, logs: DataFrame, thresholds: DataFrame, weights: DataFrame, by_run: DataFrame | None = None,
    digits: int | None = None, max_dense: int | None = None,
) -> DataFrame:
    """Mean and deviation of accuracy and AUC on ``rows`` by configuration.

    ``logs`` are run logs as read, ``thresholds`` as read, ``weights`` stored tables by
    ``weights_id``. Runs without stored weights are left out; a run without a
    threshold decides at 0. Scores are reduced to counts per run and margin once, within the tasks that make them
    where all models fit a broadcast; wider ones are joined. ``digits`` rounds margins before, so that ties do not hang
    on the order of a sum.
    """
    found = reports.with_weights(reports.flat_runs(logs), weights.select("weights_id").distinct(), by_run)
    runs = reports.with_thresholds(found, thresholds).select(
        F.concat_ws("/", "dir", "tag").alias("run_id"), "tag", "weights_id", "bias", "threshold")
    models, intercepts = run_models(runs, weights)
    counts = counted(rows, models, intercepts, digits, MAX_BROADCAST_FEATURES if max_dense is None else max_dense).join(runs.select("run_id", "tag", "threshold"), "run_id")
    by = ["run_id", "tag", "threshold"]
    return reports.accuracy_and_auc(summarize_counts(counts, F.col("threshold"), by))
