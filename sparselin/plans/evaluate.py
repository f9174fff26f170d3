"""Evaluation jobs over rows and weights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparselin.functions.rows import decide
from sparselin.operators import metrics
from sparselin.operators.grid import wide_margins
from sparselin.operators.matvec import dense_margins
from sparselin.operators.prefix import running_totals
from sparselin.plans.fit import Fit
from sparselin.session import MAX_BROADCAST_FEATURES
from sparselin.sources import weights as W
from sparselin.sources.libsvm import with_bias


Model = Fit | DataFrame | np.ndarray


def width_of(model: Model) -> int:
    """A fit and an array know their width; a table has it stored or ends with its last weight."""
    if isinstance(model, Fit):
        return model.n_features
    return len(model) if isinstance(model, np.ndarray) else W.weight_width(model)


def scores_for(rows: DataFrame, model: Model, bias: float = -1.0, n_features: int | None = None) -> DataFrame:
    """SCORES of one model, a fit, a weight table or an array.

    The model's width, or ``n_features``, is the width of the examples, bias
    included. Features the model has no weight for count 0, whatever held its
    vectors during the fit; a table that does not say how wide its model is has
    no weight beyond its last one. A bias needs the width.
    """
    width = width_of(model) if n_features is None else n_features
    stated = n_features is not None or not isinstance(model, DataFrame) or "n_features" in model.columns
    if stated or bias >= 0:
        rows, _ = with_bias(rows, bias, width)
    weights = (model.weights if model.w is None else model.w) if isinstance(model, Fit) else model
    if width > MAX_BROADCAST_FEATURES:
        table = W.from_array(rows.sparkSession, weights) if isinstance(weights, np.ndarray) else weights
        scores = wide_margins(rows, table.select("j", "w"), width)
        named = scores.drop("ask")
        named._grid = scores._grid
        return named
    if isinstance(weights, np.ndarray):
        return dense_margins(rows, np.pad(weights, (0, max(0, width - len(weights)))))
    return dense_margins(rows, W.to_array(weights, width))


def summarize(scores: DataFrame, threshold: Column | float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """``n``, ``accuracy`` and ``auc`` of each model; SCORES are reduced to counts per margin once.

    ``threshold`` may be an expression over the ``by`` columns and ``margin``.
    """
    return summarize_counts(metrics.score_counts(scores, list(by)), threshold, by)


def summarize_counts(counts: DataFrame, threshold: Column | float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """The same from positives and negatives per distinct margin."""
    by = list(by)
    ranked = running_totals(counts, "margin", {"neg_to": "neg"}, by)
    positive = decide(F.col("margin"), threshold) > 0
    hits = F.sum(F.when(positive, F.col("pos")).otherwise(F.col("neg")))
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_to") - F.col("neg") / 2))
    n_pos, n_neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return ranked.groupBy(*by).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        (hits / F.sum(F.col("pos") + F.col("neg"))).alias("accuracy"),
        F.when(n_pos * n_neg > 0, wins / (n_pos * n_neg)).otherwise(F.lit(float("nan"))).alias("auc"),
    )


def evaluate(
    rows: DataFrame, model: Model, bias: float = -1.0, threshold: float | None = None, n_features: int | None = None,
) -> DataFrame:
    """One row ``n, accuracy, auc``."""
    return summarize(scores_for(rows, model, bias, n_features), 0.0 if threshold is None else threshold)


def find_threshold(
    rows: DataFrame, model: Model, bias: float = -1.0, metric: str = "acc", n_features: int | None = None,
) -> DataFrame:
    """One THRESHOLD record for a validation set."""
    return metrics.best_threshold(scores_for(rows, model, bias, n_features), metric)
