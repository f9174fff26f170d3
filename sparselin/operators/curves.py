"""Curves of iterative runs: elapsed time, best values, relative gaps, cumulative time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparselin.functions.gaps import GAPS
from sparselin.functions.tags import nan_as_null
from sparselin.operators.prefix import running_totals


def curve_summary(history: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: number of points, smallest, first and last objective value, and the start time.

    These are combinable aggregates, so a long run is reduced before it is moved.
    """
    return history.groupBy(run).agg(
        F.count("*").alias("n_points"),
        F.min(nan_as_null(F.col("f"))).alias("f_min"),
        F.min_by("f", "iter").alias("f_first"),
        F.max_by("f", "iter").alias("f_last"),
        F.min(nan_as_null(F.col("t_sec"))).alias("t_start"),
    )


def elapsed(history: DataFrame, run: str = "run_id") -> DataFrame:
    """Add ``elapsed``: time since the first point of the run."""
    start = history.groupBy(run).agg(F.min("t_sec").alias("_start"))
    return history.join(start, run).withColumn("elapsed", F.col("t_sec") - F.col("_start")).drop("_start")


def relative_gap(history: DataFrame, variant: str = "v1", run: str = "run_id") -> DataFrame:
    """Add ``gap``: the log10 relative gap of each point.

    ``v1`` and ``v2`` compare with the smallest value over all runs, ``v3`` and
    ``v4`` with the smallest last value, ``v5`` with the run's own last value.
    """
    summary = curve_summary(history, run).select(run, "f_min", "f_first", "f_last")
    joined = history.join(summary, run)
    if variant == "v5":
        best = F.col("f_last")
    else:
        shared = "f_min" if variant in ("v1", "v2") else "f_last"
        best = summary.agg(F.min(shared)).scalar()
    return joined.withColumn("gap", GAPS[variant](F.col("f"), best, F.col("f_first"))).drop("f_min", "f_first", "f_last")


def cumulative(history: DataFrame, value: str, order: str, by: Sequence[str], name: str) -> DataFrame:
    """Add the running sum of ``value`` along ``order`` within each run."""
    return running_totals(history, order, {name: value}, by)


def row_offsets(rows: DataFrame) -> DataFrame:
    """``(row_id, start, stop)``: where each row's entries lie in the concatenated matrix."""
    sizes = rows.select("row_id", F.size("indices").cast("bigint").alias("nnz"))
    ends = running_totals(sizes, "row_id", {"stop": "nnz"})
    return ends.select("row_id", (F.col("stop") - F.col("nnz")).alias("start"), "stop")
