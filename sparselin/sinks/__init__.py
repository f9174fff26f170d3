"""Writers for lines, weights, run logs, thresholds and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparselin.functions.text import encode_line
from sparselin.schema import RUNS


def write_lines(lines: DataFrame, path: str, value: str = "value") -> None:
    """Text lines as they are, comments included."""
    lines.select(value).write.mode("overwrite").text(path)


def encode_rows(rows: DataFrame) -> DataFrame:
    """ROWS as LIBSVM lines ``(row_id, value)``."""
    return rows.select("row_id", encode_line(F.col("label"), F.col("indices"), F.col("values")).alias("value"))


def write_libsvm(rows: DataFrame, path: str) -> None:
    write_lines(encode_rows(rows), path)


def write_weights(weights: DataFrame, path: str, n_features: int | None = None) -> None:
    """A weight table, with the width of its model where the last features may have no weight."""
    if n_features is not None:
        weights = weights.withColumn("n_features", F.lit(n_features).cast("bigint"))
    weights.write.mode("overwrite").parquet(path)


def write_runs(runs: DataFrame, path: str) -> None:
    """Run logs as JSON lines, each with its tag."""
    runs.select("tag", *RUNS.names).write.mode("overwrite").json(path)


def write_records(records: DataFrame, path: str) -> None:
    """Small JSON records such as thresholds."""
    records.write.mode("overwrite").json(path)


def write_timings(timings: DataFrame, path: str) -> None:
    """Rows ``(strategy, iter, t_sec, f)`` as one JSON document per strategy with parallel arrays.

    A strategy has one entry per repetition, so the arrays stay short.
    """
    ordered = F.sort_array(F.collect_list(F.struct("iter", "t_sec", "f")))
    packed = timings.groupBy("strategy").agg(ordered.alias("x"))
    arrays = {}
    for s in ("map", "mappart"):
        here = F.col("strategy") == s
        arrays[f"t_{s}"] = F.when(here, F.col("x.t_sec"))
        arrays[f"f_{s}"] = F.when(here, F.col("x.f"))
    packed.select(*(c.alias(k) for k, c in arrays.items())).write.mode("overwrite").json(path)
