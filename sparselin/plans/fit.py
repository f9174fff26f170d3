"""Fits as functions of DataFrames: rows in; weights, history and run log out."""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparselin.functions import tags
from sparselin.functions.losses import get_loss
from sparselin.operators.matvec import check
from sparselin.operators.objective import Blocks
from sparselin.plans.newton import NewtonOptions, NewtonResult, iterations, minimize, minimize_together
from sparselin.plans.vectors import CooProblem, DenseProblem, SlicedFits, SlicedProblem, TableProblem
from sparselin.plans.states import read_state, write_state
from sparselin.schema import HISTORY, RUNS
from sparselin.session import MAX_BROADCAST_FEATURES
from sparselin.sources.libsvm import feature_width, read_libsvm

STRATEGIES = ("auto", "partition", "coo", "grid", "table")


@dataclass
class Fit:
    """A finished fit. ``weights`` is ``(j, w)``; ``w`` is its array unless vectors were tables."""

    tag: str
    weights: DataFrame
    result: NewtonResult
    config: dict
    started: float
    time_sec: float
    strategy: str

    @property
    def w(self) -> np.ndarray | None:
        return self.result.w if isinstance(self.result.w, np.ndarray) else None

    @property
    def n_features(self) -> int:
        """The width of the model, also where the last features have no weight."""
        return int(self.config["n_features"])

    def history(self, spark: SparkSession) -> DataFrame:
        records = [{"run_id": self.tag, **row} for row in self.result.history]
        return spark.createDataFrame(records, HISTORY)

    def run(self, spark: SparkSession, weights_path: str = "") -> DataFrame:
        return run_log(spark, self.tag, self.config, {
            "iters": self.result.iters,
            "final_f": self.result.f,
            "final_grad_norm": self.result.g_norm,
            "reason": self.result.reason,
            "time_sec": self.time_sec,
            "start_time_epoch": self.started,
            "end_time_epoch": self.started + self.time_sec,
            "weights_path": weights_path,
        }, self.result.history, mode=f"spark-{self.strategy}", started=self.started)


def run_log(
    spark: SparkSession, tag: str, config: dict, summary: dict, history: list[dict], mode: str, started: float,
) -> DataFrame:
    """One RUNS record with its tag."""
    record = {"meta": {"mode": mode}, "config": config, "summary": summary, "history": history}
    at = tags.utc_stamp(F.timestamp_micros(F.lit(int(started * 1e6))))
    return spark.createDataFrame([record], RUNS).select(
        F.lit(tag).alias("tag"), F.col("meta").withField("timestamp_utc", at).alias("meta"), "config", "summary", "history")


def run_tag(solver: str, C: float, eps: float, bias: float, rep: int | None = None) -> str:
    tag = f"{solver}_C{C:g}_eps{eps:g}_bias{bias:g}"
    return tag if rep is None else f"{tag}_rep{rep}"


def solve(problem, strategy: str, solver: str, C: float, eps: float, max_iter: int, tag: str | None = None,
          bias: float = -1.0, callback=None, options: NewtonOptions | None = None, spark=None, states: str | None = None, **config) -> Fit:
    started = time.time()
    settings = {"options": options, "callback": callback, "eps": eps, "max_iter": max_iter}
    if states:
        settings["resumed"] = read_state(spark, states, problem, solver, C)
        settings["keep"] = lambda state: write_state(spark, states, problem, solver, C, state)
    if isinstance(problem, SlicedProblem):
        result = minimize_together([iterations(problem, **settings)], lambda asked: problem.fits.answers([(problem, r) for _, r in asked]))[0]
    else:
        result = minimize(problem, **settings)
    return finished(result, problem, strategy, solver, C, eps, max_iter, started, tag, bias, spark, **config)


def finished(result: NewtonResult, problem, strategy: str, solver: str, C: float, eps: float, max_iter: int, started: float,
             tag: str | None = None, bias: float = -1.0, spark=None, weights: DataFrame | None = None, **config) -> Fit:
    """``weights`` is the model as a table, where it is made already."""
    spent = time.time() - started
    tag = tag or run_tag(solver, C, eps, bias)
    settings = {"solver": solver, "C": float(C), "eps": float(eps), "bias": float(bias), "maxIter": max_iter,
                "n_features": problem.n_features, **config}
    return Fit(tag, problem.to_table(result.w, spark) if weights is None else weights, result, settings, started, spent, strategy)


def fit(
    rows: DataFrame,
    solver: str = "lr",
    C: float = 1.0,
    eps: float = 1e-2,
    max_iter: int = 100,
    strategy: str = "auto",
    n_features: int | None = None,
    partitions: int | None = None,
    bias: float = -1.0,
    tag: str | None = None,
    callback=None,
    options: NewtonOptions | None = None,
    seed: int | None = None,
    span: int | None = None,
    states: str | None = None,
) -> Fit:
    """Fit L2-regularised logistic regression (``lr``) or squared-hinge SVM (``l2svm``).

    ``partition`` packs the rows and accumulates per task, ``coo`` joins and
    aggregates; both keep weight vectors on the driver and need a width within
    the broadcast bound. ``grid`` cuts the rows by feature ranges and keeps the
    vectors in tables of slices of ``span`` features, ``table`` does so by joins; they have no
    bound. ``auto`` takes ``partition`` within the bound and ``grid`` beyond.
    The fit starts from 0 and draws no random numbers; ``seed`` is only logged. With a folder for
    ``states`` every accepted step is stored there, and a fit that was ended goes on from the last one.
    """
    loss = get_loss(solver)
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {STRATEGIES}")
    spark = rows.sparkSession
    width = n_features
    if partitions and strategy in ("auto", "partition"):
        rows = rows.repartition(partitions)
    blocks = None
    if strategy == "auto" and width is None:
        # The rows are read once: packed, they tell their width.
        blocks = Blocks(rows, any_width=True)
        width = blocks.n_features
    if strategy == "auto":
        strategy = "partition" if width <= MAX_BROADCAST_FEATURES else "grid"
    if strategy == "partition":
        blocks = blocks or Blocks(rows, width)
        problem, close = DenseProblem(blocks, loss, C), blocks.close
    else:
        if blocks:
            blocks.close()
        width = feature_width(rows) if width is None else width
        if strategy == "grid":
            fits = SlicedFits(rows, width, span)
            problem, close = SlicedProblem(fits, loss, C), fits.close
        else:
            kind = CooProblem if strategy == "coo" else TableProblem
            problem = kind(rows, width, loss, C, partitions)
            close = problem.close
    try:
        return solve(problem, strategy, solver, C, eps, max_iter, tag, bias, callback, options, spark,
                     states, numPartitions=partitions, seed=seed)
    finally:
        close()


def fit_file(spark: SparkSession, path: str, bias: float = -1.0, partitions: int | None = None, **kw) -> Fit:
    """Read LIBSVM text, check it and fit."""
    rows, width = read_libsvm(spark, path, bias, partitions=partitions)
    check(rows, width)
    fitted = fit(rows, n_features=width, bias=bias, partitions=partitions, **kw)
    fitted.config["data_path"] = path
    return fitted
