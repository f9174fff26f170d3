"""Evaluation of SCORES: accuracy, confusion, ROC-AUC and the best threshold.

Every function takes optional grouping columns, so many models are evaluated by
the same plan. Scores are reduced to counts per distinct margin before anything
is ordered; AUC and thresholds take such counts as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparselin.functions.rows import decide
from sparselin.functions.text import is_positive
from sparselin.operators.prefix import running_totals


def predict(scores: DataFrame, threshold: Column | float = 0.0) -> DataFrame:
    return scores.withColumn("prediction", decide(F.col("margin"), threshold))


def accuracy(predicted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return predicted.groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _share(2 * tp, 2 * tp + fp + fn)


def confusion(predicted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts with precision, recall and F1; an undefined share is 0."""
    truth, guess = F.col("label") > 0, F.col("prediction") > 0
    counts = predicted.groupBy(*by).agg(
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
        F.count_if(~truth & ~guess).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn), "f1": f1(tp, fp, fn)})


def score_counts(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct margin."""
    return scores.groupBy(*by, "margin").agg(
        F.count_if(is_positive(F.col("label"))).alias("pos"),
        F.count_if(~is_positive(F.col("label"))).alias("neg"),
    )


def _counts(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Scores may be counted already."""
    return scores if {"margin", "pos", "neg"} <= set(scores.columns) else score_counts(scores, by)


def roc_auc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half; NaN without both classes."""
    ranked = running_totals(_counts(scores, by), "margin", {"neg_to": "neg"}, by)
    # The number of pairs outgrows 64 bits before the number of rows does.
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_to") - F.col("neg") / 2))
    n_pos, n_neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return ranked.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.when(n_pos * n_neg > 0, wins / (n_pos * n_neg)).otherwise(F.lit(float("nan"))).alias("auc"),
    )


def _swept(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Confusion counts at every distinct margin, NaN included, at which nothing is positive."""
    counts = _counts(scores, by).withColumns({
        "_nan_pos": F.when(F.isnan("margin"), F.col("pos")).otherwise(F.lit(0)),
        "_nan_neg": F.when(F.isnan("margin"), F.col("neg")).otherwise(F.lit(0)),
    })
    swept = running_totals(
        counts, "margin", {"pos_to": "pos", "neg_to": "neg"}, by,
        totals={"n_pos": "pos", "n_neg": "neg", "nan_pos": "_nan_pos", "nan_neg": "_nan_neg"},
    )
    # A NaN margin is never positive, so it is below every threshold although it sorts last.
    below_pos = F.col("pos_to") - F.col("pos") + F.when(F.isnan("margin"), F.col("pos")).otherwise(F.col("nan_pos"))
    below_neg = F.col("neg_to") - F.col("neg") + F.when(F.isnan("margin"), F.col("neg")).otherwise(F.col("nan_neg"))
    return swept.select(
        *by, "margin", "n_pos", "n_neg",
        (F.col("n_pos") - below_pos).alias("tp"), (F.col("n_neg") - below_neg).alias("fp"),
        below_pos.alias("fn"), below_neg.alias("tn"),
    )


def threshold_curve(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts when predicting positive from each distinct margin upwards; NaN margins are negative."""
    return _swept(scores, by).where(~F.isnan("margin"))


def best_threshold(scores: DataFrame, metric: str = "acc", by: Sequence[str] = ()) -> DataFrame:
    """The decision threshold with the best accuracy or F1.

    Candidates are the distinct margins, of which the smallest wins a tie, and
    then 0.0. The latter can only win where no margin reaches it, that is when
    predicting nothing as positive is strictly better than every margin, or
    where all margins are NaN.
    """
    if metric not in ("acc", "f1"):
        raise ValueError(f"unknown metric {metric!r}; known: acc, f1")
    curve = _swept(scores, by)
    n = F.col("n_pos") + F.col("n_neg")
    if metric == "acc":
        score, nothing = (F.col("tp") + F.col("tn")) / n, F.col("n_neg") / n
    else:
        score, nothing = f1(F.col("tp"), F.col("fp"), F.col("fn")), F.lit(0.0)
    usable = ~F.isnan("margin")
    best = curve.select(*by, "margin", score.alias("score"), nothing.alias("nothing")).groupBy(*by).agg(
        # The largest (score, -margin) is the smallest margin among the best scores.
        F.max(F.when(usable, F.struct(F.col("score").alias("s"), (-F.col("margin")).alias("m")))).alias("top"),
        F.max(F.when(usable, F.col("margin"))).alias("largest"), F.max("nothing").alias("nothing"),
    )
    zero_wins = F.col("top").isNull() | ((F.col("largest") < 0) & (F.col("nothing") > F.col("top.s")))
    return best.select(
        *by, F.lit(metric).alias("metric"),
        F.when(zero_wins, F.lit(0.0)).otherwise(-F.col("top.m") + 0.0).alias("best_threshold"),
        F.when(zero_wins, F.col("nothing")).otherwise(F.col("top.s")).alias("best_score"),
    )
