"""States of unfinished fits in the shared folder, so that a fit survives its driver.

A state is a folder per accepted step: the weights, then, when they are complete, one record of the solver's figures and
history. A fit that finds states at its place goes on from the latest complete one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparselin import sinks
from sparselin.plans.newton import NewtonResult
from sparselin.schema import STEP
from sparselin.session import delete
from sparselin.sources import weights as W

FIGURES = ("f", "g_norm", "delta", "f0", "g0_norm")
STATE = T.StructType([
    T.StructField("iters", T.IntegerType()), T.StructField("solver", T.StringType()), T.StructField("C", T.DoubleType()),
    T.StructField("n_features", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in FIGURES),
    T.StructField("history", T.ArrayType(STEP)),
])


def _folder(path: str, step: int) -> str:
    return f"{path.rstrip('/')}/step-{step:06d}"


def write_state(spark: SparkSession, path: str, problem, solver: str, C: float, state: NewtonResult) -> None:
    """Write the state of an accepted step; the states before the last one are not needed any more."""
    here = _folder(path, state.iters)
    sinks.write_weights(problem.to_table(state.w, spark), f"{here}/weights", problem.n_features)
    record = {"iters": state.iters, "solver": solver, "C": float(C), "n_features": problem.n_features,
              **{n: float(getattr(state, n)) for n in FIGURES}, "history": state.history}
    spark.createDataFrame([record], STATE).coalesce(1).write.mode("overwrite").parquet(f"{here}/state")
    accepted = [row["iter"] for row in state.history if row["accepted"]]
    for step in accepted[:-2]:
        delete(spark, _folder(path, step))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """All complete states; no row if there is none."""
    try:
        return spark.read.schema(STATE).parquet(f"{path.rstrip('/')}/step-*/state")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE)


def read_state(spark: SparkSession, path: str, problem, solver: str, C: float) -> NewtonResult | None:
    """The latest state, if there is one. That of another problem is an error."""
    found = read_states(spark, path).orderBy(F.desc("iters")).first()
    if found is None:
        return None
    if (found["solver"], found["C"], found["n_features"]) != (solver, float(C), problem.n_features):
        raise ValueError(f"the states at {path} are those of another fit")
    w = problem.from_table(W.read_weights(spark, f"{_folder(path, found['iters'])}/weights"))
    return NewtonResult(w, found["f"], found["g_norm"], found["delta"], found["iters"], "max_iter", found["f0"], found["g0_norm"],
                        [row.asDict() for row in found["history"]])
