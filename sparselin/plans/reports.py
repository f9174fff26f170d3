"""Tables over run logs: joins with thresholds and weights, group statistics, convergence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparselin.functions import tags
from sparselin.operators.curves import curve_summary


def flat_runs(runs: DataFrame) -> DataFrame:
    """One record per run with the fields reports use; a missing number is NaN."""
    return runs.select(
        "path", "dir", "tag", tags.base_tag(F.col("tag")).alias("base"),
        tags.solver_name(F.col("config.solver"), F.col("tag")).alias("solver"),
        F.coalesce("config.bias", F.lit(-1.0)).alias("bias"),
        tags.or_nan(F.col("summary.time_sec")).alias("time_sec"),
        tags.or_nan(F.coalesce("summary.final_f", "summary.f_train")).alias("final_f"),
        F.coalesce("summary.weights_path", F.lit("")).alias("weights_path"),
    )


def with_thresholds(runs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Add each run's decision threshold, 0 where none was found."""
    found = thresholds.select("dir", "tag", "best_threshold")
    return runs.join(found, ["dir", "tag"], "left").withColumn(
        "threshold", F.coalesce("best_threshold", F.lit(0.0))).drop("best_threshold")


def with_weights(runs: DataFrame, available: DataFrame, by_run: DataFrame | None = None) -> DataFrame:
    """Add ``weights_id``: the weights stored for the run itself, else those its log names.

    ``available`` lists stored weights as ``weights_id``; ``by_run`` maps
    ``(dir, tag)`` to them. Runs without stored weights are dropped.
    """
    logged = available.select(F.col("weights_id").alias("_logged"))
    joined = runs.join(logged, runs["weights_path"] == logged["_logged"], "left")
    chosen = F.col("_logged")
    if by_run is not None:
        own = by_run.select("dir", "tag", F.col("weights_id").alias("_own"))
        joined = joined.join(own, ["dir", "tag"], "left")
        chosen = F.coalesce("_own", "_logged")
    return joined.withColumn("weights_id", chosen).where(F.col("weights_id").isNotNull()).drop("_logged", "_own")


def group_stats(values: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("base",)) -> DataFrame:
    """Mean and population deviation per group; NaN values are left out, an empty group gives NaN."""
    out = [F.count("*").alias("n")]
    for m in metrics:
        x = tags.nan_as_null(F.col(m))
        out += [tags.or_nan(F.avg(x)).alias(f"{m}_mean"), tags.or_nan(F.stddev_pop(x)).alias(f"{m}_std")]
    return values.groupBy(*by).agg(*out)


def time_and_objective(flat: DataFrame) -> DataFrame:
    """Time and final objective per configuration; the solver is that of the group's first log."""
    first = flat.groupBy("base").agg(F.min_by("solver", "path").alias("solver"))
    stats = group_stats(flat, ["time_sec", "final_f"]).join(first, "base")
    return ordered(stats.withColumns({
        "C": tags.c_from_tag(F.col("base")), "label": tags.short_label(F.col("base"))}))


def accuracy_and_auc(scored: DataFrame) -> DataFrame:
    """Accuracy and AUC per configuration, from ``(tag, accuracy, auc)``."""
    stats = group_stats(scored.withColumn("base", tags.base_tag(F.col("tag"))), ["accuracy", "auc"])
    return ordered(stats.withColumns({
        "C": tags.c_from_tag(F.col("base")), "label": tags.short_label(F.col("base"))}))


def ordered(groups: DataFrame) -> DataFrame:
    return groups.orderBy("C", "base")


def convergence(history: DataFrame, solvers: DataFrame, which: Sequence[str] = ("lr", "l2svm")) -> DataFrame:
    """Objective and gradient norm over time for the runs of the named solvers.

    ``solvers`` maps ``run_id`` to ``solver``. Runs without a usable time, null or
    NaN in every iteration, are left out as a whole.
    """
    timed = history.groupBy("run_id").agg(F.count(tags.nan_as_null(F.col("t_sec"))).alias("_timed"))
    chosen = solvers.where(F.col("solver").isin(list(which))).select("run_id", "solver").join(
        timed.where(F.col("_timed") > 0), "run_id").select("run_id", "solver")
    return history.join(chosen, "run_id").select("run_id", "solver", "t_sec", "f", "g_norm")


def compare_curves(history: DataFrame) -> DataFrame:
    """First, best and last objective per run, next to the best over all runs."""
    summary = curve_summary(history)
    shared = summary.agg(F.min("f_min")).scalar()
    return summary.withColumn("f_best", shared)
