"""Spark ML fits of the same problems, for comparison."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparselin.functions.losses import LOGISTIC
from sparselin.functions.tags import reg_param
from sparselin.functions.text import binary_label
from sparselin.operators.objective import Blocks
from sparselin.operators.prefix import running_totals
from sparselin.session import scratch_path
from sparselin.sources.libsvm import feature_width

# Iteration limits of the convergence curve, and the kind of a stored sparse vector.
ITERATION_GRID = (1, 2, 3, 5, 10, 20, 50, 100)
SPARSE = 0
MAX_ML_FEATURES = 2**31 - 1


def to_ml(rows: DataFrame, n_features: int, path: str | None = None) -> DataFrame:
    """ROWS with an ML vector column ``features``, labels kept.

    The examples are written once in the storage layout of ML vectors and read
    back as such, which stays inside the JVM and serves the repeated passes of
    the fits.
    """
    if n_features > MAX_ML_FEATURES:
        raise ValueError("ML vectors have 32-bit indices")
    path = path or scratch_path(rows.sparkSession, "ml-rows")
    rows.select(
        "row_id", "label",
        F.struct(
            F.lit(SPARSE).cast("tinyint").alias("type"), F.lit(n_features).cast("int").alias("size"),
            F.col("indices").cast("array<int>").alias("indices"), F.col("values").alias("values"),
        ).alias("features"),
    ).write.mode("overwrite").parquet(path)
    schema = T.StructType([
        T.StructField("row_id", T.LongType()), T.StructField("label", T.DoubleType()),
        T.StructField("features", VectorUDT()),
    ])
    return rows.sparkSession.read.schema(schema).parquet(path)


def vector_rows(ml: DataFrame, row_id: str = "row_id") -> DataFrame:
    """ROWS of an ML vector column: exactly its stored entries, zeros included.

    Vectors are read by their storage layout in place, so a wide sparse vector is
    never spread out.
    """
    stored = ml.select(F.col(row_id).alias("row_id"), "label", F.unwrap_udt("features").alias("features"))
    # A dense vector stores values only. An empty range needs its own branch, since a sequence would count down.
    length = F.size("features.values")
    positions = F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))
    indices = F.when(F.col("features.type") == SPARSE, F.col("features.indices")).otherwise(positions)
    return stored.select(
        "row_id", "label", indices.cast("array<bigint>").alias("indices"), F.col("features.values").alias("values"))


def with_class_labels(ml: DataFrame) -> DataFrame:
    """Labels 1 and 0, the only ones Spark ML's binary classifiers take."""
    return ml.withColumn("label", binary_label(F.col("label"), negative=0.0))


@dataclass
class Baseline:
    model: object
    w: np.ndarray
    intercept: float
    reg_param: float
    time_sec: float


def _train(estimator, ml: DataFrame) -> Baseline:
    start = time.time()
    model = estimator.fit(with_class_labels(ml))
    spent = time.time() - start
    return Baseline(model, model.coefficients.toArray(), model.intercept, estimator.getRegParam(), spent)


def fit_lr(ml: DataFrame, C: float = 1.0, max_iter: int = 100, tol: float = 1e-6,
           fit_intercept: bool = False, n_rows: int | None = None) -> Baseline:
    """Logistic regression with the penalty that makes its optimum that of the C-weighted objective."""
    return _train(LogisticRegression(
        maxIter=max_iter, regParam=reg_param(C, n_rows or ml.count()), elasticNetParam=0.0,
        standardization=False, tol=tol, fitIntercept=fit_intercept), ml)


def fit_linsvc(ml: DataFrame, reg: float = 1.0, max_iter: int = 100, tol: float = 1e-6) -> Baseline:
    """Linear SVM with the plain hinge, hence a different objective from ``l2svm``."""
    return _train(LinearSVC(
        maxIter=max_iter, regParam=reg, tol=tol, standardization=False, fitIntercept=False), ml)


def ml_scores(model, ml: DataFrame) -> DataFrame:
    """SCORES of a fitted model: the raw score of the positive class, labels +1/-1."""
    return model.transform(ml).select(
        "row_id", binary_label(F.col("label")).alias("label"),
        F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("margin"))


def lr_curve(
    rows: DataFrame,
    C: float = 1.0,
    grid: Sequence[int] = ITERATION_GRID,
    tol: float = 1e-6,
    n_features: int | None = None,
) -> DataFrame:
    """``(max_iter, dt, t_sec, f)``: one fit per iteration limit and its C-weighted objective.

    The objectives of all fitted models come from one pass over the rows.
    """
    spark = rows.sparkSession
    width = feature_width(rows) if n_features is None else n_features
    ml = to_ml(rows, width)
    n_rows = ml.count()
    fits = [fit_lr(ml, C, k, tol, n_rows=n_rows) for k in grid]
    with Blocks(rows, width) as blocks:
        losses = blocks.losses_at(LOGISTIC, [b.w for b in fits])
    points = spark.createDataFrame(
        [("mllib_lr", int(k), float(b.time_sec), 0.5 * float(b.w @ b.w) + C * total)
         for k, b, total in zip(grid, fits, losses)],
        "run_id string, max_iter int, dt double, f double")
    timed = running_totals(points, "max_iter", {"t_sec": "dt"}, ["run_id"])
    return timed.select("max_iter", "dt", "t_sec", "f")
