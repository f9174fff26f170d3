"""Hyper-parameter sweeps: many fits on one packed training set, all models scored at once.

Models within the broadcast bound are arrays, wider ones tables; either way all fits that wait share a pass.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparselin.functions.losses import get_loss
from sparselin.operators import grid as G
from sparselin.operators import metrics
from sparselin.operators.matvec import model_counts, model_margins
from sparselin.operators.objective import Blocks, within
from sparselin.plans.evaluate import summarize_counts
from sparselin.plans.fit import Fit, finished, run_tag
from sparselin.plans.newton import ARITHMETIC, answered, iterations, minimize_together
from sparselin.plans.vectors import DenseProblem, SlicedFits, SlicedProblem
from sparselin.session import MAX_BROADCAST_FEATURES, materialize, scratch_path
from sparselin.sources import weights as W
from sparselin.sources.libsvm import with_bias

# The default grid.
C_GRID = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)
EPS_GRID = (1e-3, 1e-4)
REPETITIONS = 3
SOLVERS = ("lr", "l2svm")


# Arrays by run, or a table ``(run_id, j, w, n_features)`` for any width.
Models = dict[str, np.ndarray] | DataFrame


@dataclass
class Sweep:
    fits: list[Fit]

    @property
    def models(self) -> Models:
        if all(f.w is not None for f in self.fits):
            return {f.tag: f.w for f in self.fits}
        return self.weights(self.fits[0].weights.sparkSession)

    def runs(self, spark, weights_root: str = "") -> DataFrame:
        paths = {f.tag: f"{weights_root}/w_{f.tag}" if weights_root else "" for f in self.fits}
        return reduce(DataFrame.unionByName, (f.run(spark, paths[f.tag]) for f in self.fits))

    def weights(self, spark) -> DataFrame:
        """``(run_id, j, w)`` of all models, with the width where it is not that of an array."""
        return reduce(DataFrame.unionByName, (
            W.from_array(spark, f.w, f.tag) if f.w is not None else f.weights.select(
                F.lit(f.tag).alias("run_id"), "j", "w", F.lit(f.n_features).cast("bigint").alias("n_features")) for f in self.fits))


def sweep(
    rows: DataFrame,
    solvers: Sequence[str] = SOLVERS,
    Cs: Sequence[float] = C_GRID,
    epss: Sequence[float] = EPS_GRID,
    reps: int = REPETITIONS,
    bias: float = -1.0,
    max_iter: int = 100,
    n_features: int | None = None,
    max_dense: int | None = None,
    span: int | None = None,
) -> Sweep:
    """Fit the whole grid in lockstep: a pass over the rows serves all fits that are not done yet.

    The grid takes about as many passes as its slowest fit. A fit is
    deterministic, so the repetitions of a configuration share one. Up to ``max_dense`` features (the broadcast
    bound) the models are arrays on the driver; wider ones are tables of slices of ``span`` features, and so is every
    vector of the fits.
    """
    rows, width = with_bias(rows, bias, n_features)
    spark, started = rows.sparkSession, time.time()
    grid = [(solver, C, eps) for solver in solvers for C in Cs for eps in epss]
    dense = width <= (MAX_BROADCAST_FEATURES if max_dense is None else max_dense)
    data = Blocks(rows, width) if dense else SlicedFits(rows, width, span)
    problems = [(DenseProblem if dense else SlicedProblem)(data, get_loss(solver), C) for solver, C, _ in grid]

    def answers(pending):
        if not dense:
            return data.answers([(problems[i], request) for i, request in pending])
        if pending[0][1][0] in ARITHMETIC:
            return [answered(problems[i], request) for i, request in pending]
        found = data.answers([(problems[i].loss, *request) for i, request in pending])
        return [problems[i].completed(request, x) for (i, request), x in zip(pending, found)]

    try:
        results = minimize_together([iterations(p, eps=eps, max_iter=max_iter) for p, (_, _, eps) in zip(problems, grid)], answers)
        tables = [p.to_table(r.w, spark) for p, r in zip(problems, results)]
    finally:
        data.close()
    return Sweep([
        finished(result, problem, "partition" if dense else "grid", solver, C, eps, max_iter, started, run_tag(solver, C, eps, bias, rep),
                 bias, spark, weights=table, seed=rep)
        for result, problem, table, (solver, C, eps) in zip(results, problems, tables, grid) for rep in range(1, reps + 1)])


def _numbered(models: DataFrame) -> tuple[list[str], DataFrame]:
    """The runs of a model table and the table with their numbers ``ask``."""
    names = sorted(r["run_id"] for r in models.select("run_id").distinct().collect())
    numbers = models.sparkSession.createDataFrame(list(enumerate(names)), "ask int, run_id string")
    return names, models.join(F.broadcast(numbers), "run_id")


def score_sweep(rows: DataFrame, models: Models, bias: float = -1.0, span: int | None = None) -> DataFrame:
    """``(run_id, row_id, label, margin)``; models are taken in groups that fit one broadcast, tables in groups of a pass."""
    if isinstance(models, DataFrame):
        width = W.weight_width(models)
        rows, _ = with_bias(rows, bias, width)
        names, numbered = _numbered(models)
        scores = G.wide_margins(rows, numbered.select("ask", "j", "w"), width, len(names), span)
        run = F.element_at(F.array(*map(F.lit, names)), F.col("ask") + 1)
        named = scores.select(run.alias("run_id"), "row_id", "label", "margin")
        named._grid = scores._grid
        return named
    rows, groups = _dense_groups(rows, models, bias)
    return reduce(DataFrame.unionByName, (model_margins(rows, g) for g in groups))


def _dense_groups(rows: DataFrame, models: dict[str, np.ndarray], bias: float) -> tuple[DataFrame, list[dict[str, np.ndarray]]]:
    width = max(map(len, models.values()))
    rows, _ = with_bias(rows, bias, width)
    size = max(1, MAX_BROADCAST_FEATURES // width)
    names = sorted(models)
    return rows, [{n: models[n] for n in names[i:i + size]} for i in range(0, len(names), size)]


def count_sweep(rows: DataFrame, models: Models, bias: float = -1.0) -> DataFrame:
    """``(run_id, margin, pos, neg)``: what thresholds and reports need of the scores. Arrays are counted in the tasks."""
    if isinstance(models, DataFrame):
        scores = score_sweep(rows, models, bias)
        return materialize(metrics.score_counts(scores, ["run_id"]), scratch_path(rows.sparkSession, "counts"))
    rows, groups = _dense_groups(rows, models, bias)
    return reduce(DataFrame.unionByName, (model_counts(rows, g) for g in groups))


def thresholds(validation: DataFrame, models: Models, bias: float = -1.0, metric: str = "acc") -> DataFrame:
    """The best threshold of every model: ``(run_id, metric, best_threshold, best_score)``."""
    return metrics.best_threshold(count_sweep(validation, models, bias), metric, ["run_id"])


def report_on_test(
    test: DataFrame, models: Models, found: DataFrame | None = None, bias: float = -1.0,
) -> DataFrame:
    """``(run_id, n, accuracy, auc)``; a model without a found threshold decides at 0."""
    counts = count_sweep(test, models, bias)
    if found is None:
        return summarize_counts(counts, by=["run_id"])
    # One record per model.
    cuts = F.broadcast(found.select("run_id", "best_threshold"))
    cut = counts.join(cuts, "run_id", "left").withColumn("threshold", F.coalesce("best_threshold", F.lit(0.0)))
    return summarize_counts(cut, F.col("threshold"), ["run_id", "threshold"])


def objective_grid(
    rows: DataFrame, weights: DataFrame, solver: str, C: float, n_features: int | None = None, max_dense: int | None = None,
    span: int | None = None,
) -> DataFrame:
    """``(run_id, f)`` at the weights of every run, from one pass over the rows for as many as fit a broadcast or a pass."""
    spark, loss = rows.sparkSession, get_loss(solver)
    names, numbered = _numbered(weights)
    limit = MAX_BROADCAST_FEATURES if max_dense is None else max_dense
    width, blocks = n_features, None
    if width is None:
        blocks = Blocks(rows, any_width=True)
        width = blocks.n_features
    try:
        if width <= limit // max(1, len(names)):
            blocks = blocks or Blocks(rows, width)
            # All models are no more than a broadcast.
            found = numbered.select("ask", "j", "w").toArrow()
            arrays = np.zeros((len(names), width))
            np.add.at(arrays, (found["ask"].to_numpy(), found["j"].to_numpy()), found["w"].to_numpy())
            losses, squares = blocks.losses_at(loss, list(arrays)), (arrays * arrays).sum(axis=1).tolist()
        else:
            with G.Grid(within(rows, width), width, span) as grid:
                slices = materialize(G.sliced(numbered.select("ask", "j", "w"), grid.span, ask="ask"), scratch_path(spark, "slices"))
                losses = grid.losses(slices, loss, len(names))
            norms = {r["ask"]: r["s"] for r in slices.groupBy("ask").agg(F.sum("square").alias("s")).collect()}
            squares = [norms.get(k, 0.0) for k in range(len(names))]
    finally:
        if blocks:
            blocks.close()
    return spark.createDataFrame([(n, 0.5 * q + C * total) for n, q, total in zip(names, squares, losses)], "run_id string, f double")
