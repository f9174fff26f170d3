"""Both ways of summing up a pass, timed on the same fit."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparselin import sinks
from sparselin.plans.fit import fit

# The names of the two ways in timing files, and the strategies behind them.
WAYS = {"map": "coo", "mappart": "partition"}


def time_strategies(rows: DataFrame, path: str, solver: str = "l2svm", C: float = 1.0, eps: float = 1e-3,
                    n_features: int | None = None, **kw) -> DataFrame:
    """Fit by joins and by blocks, and write the time and objective of every iteration as timings to ``path``.

    Gives ``strategy, iter, t_sec, f`` as written. The objectives of an iteration agree but for the order of sums, so
    the times are those of the same work.
    """
    spark = rows.sparkSession
    steps = []
    for way, strategy in WAYS.items():
        done = fit(rows, solver, C, eps, strategy=strategy, n_features=n_features, **kw)
        steps += [(way, row["iter"], row["t_sec"], row["f"]) for row in done.result.history]
    timed = spark.createDataFrame(steps, "strategy string, iter int, t_sec double, f double")
    sinks.write_timings(timed, path)
    return timed
