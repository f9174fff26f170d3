"""Weight tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparselin.session import MAX_BROADCAST_FEATURES


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def weight_width(weights: DataFrame) -> int:
    """Number of features a model has: as stored with its weights, else up to the last one with a weight."""
    last = F.coalesce(F.max("j"), F.lit(-1)) + 1
    if "n_features" in weights.columns:
        last = F.greatest(last, F.max("n_features"))
    return weights.agg(last).first()[0]


def from_array(spark: SparkSession, w: np.ndarray, run_id: str | None = None) -> DataFrame:
    """A dense vector as a weight table, zeros included."""
    table = pa.table({"j": np.arange(len(w), dtype=np.int64), "w": np.asarray(w, dtype=np.float64)})
    frame = spark.createDataFrame(table)
    return frame if run_id is None else frame.select(F.lit(run_id).alias("run_id"), "j", "w")


def from_arrays(spark: SparkSession, **columns: np.ndarray) -> DataFrame:
    """Several vectors of one length as columns of one table."""
    width = len(next(iter(columns.values())))
    return spark.createDataFrame(pa.table({"j": np.arange(width, dtype=np.int64), **columns}))


def to_array(weights: DataFrame, n_features: int | None = None, column: str = "w") -> np.ndarray:
    """A weight table as a dense vector; only for widths that fit a broadcast."""
    width = weight_width(weights) if n_features is None else n_features
    if width > MAX_BROADCAST_FEATURES:
        raise ValueError(f"{width} features exceed the dense limit of {MAX_BROADCAST_FEATURES}")
    found = weights.select("j", column).toArrow()
    w = np.zeros(width)
    np.add.at(w, found["j"].to_numpy(), found[column].to_numpy())
    return w


def by_rule(width_of: DataFrame, multiplier: int, modulus: int, shift: int) -> DataFrame:
    """Reproducible weights ``((j * multiplier) % modulus - shift) / 10`` for the ids in ``width_of``."""
    j = F.col("j")
    return width_of.select(j, (((j * multiplier) % modulus - shift).cast("double") / 10.0).alias("w"))
