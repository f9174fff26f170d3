"""Run logs: one JSON document per run."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparselin.functions import tags
from sparselin.operators.prefix import running_totals
from sparselin.schema import RUNS, THRESHOLD, TIMINGS

# Unreadable documents become null records, and NaN may be spelled out.
_READ = {"mode": "PERMISSIVE", "allowNonNumericNumbers": True}


def read_runs(spark: SparkSession, pattern: str, one_per_file: bool = True) -> DataFrame:
    """Run logs with their ``path``, ``dir`` and ``tag``.

    A file holds one document and is named after its run, or, with
    ``one_per_file=False``, one document per line that names its run itself.
    """
    schema = T.StructType([T.StructField("tag", T.StringType()), *RUNS.fields])
    logs = spark.read.schema(schema).options(**_READ, multiLine=one_per_file).json(pattern)
    named = logs.select(F.col("_metadata.file_path").alias("path"), "*")
    tag = F.coalesce("tag", tags.run_tag(F.col("path")))
    return named.select("path", tags.run_folder(F.col("path")).alias("dir"), tag.alias("tag"), *RUNS.names)


def in_path_order(runs: DataFrame, name: str = "position") -> DataFrame:
    """The runs with their places from 0 by path, those of one path by tag; equal ones share the last place."""
    places = runs.groupBy("path", "tag").agg(F.count("*").alias("_n")).withColumn("_at", F.struct("path", "tag"))
    upto = running_totals(places, "_at", {"_upto": "_n"}).select("path", "tag", (F.col("_upto") - 1).alias(name))
    return runs.join(upto, ["path", "tag"])


def run_solver(runs: DataFrame) -> DataFrame:
    return runs.withColumn("solver", tags.solver_name(F.col("config.solver"), F.col("tag")))


def run_history(runs: DataFrame, keep_empty: bool = True) -> DataFrame:
    """One record per iteration.

    A log without ``t_sec`` gets a uniform time axis over the total run time.
    Runs without history vanish, or raise when ``keep_empty`` is False.
    """
    if not keep_empty and runs.where(F.coalesce(F.size("history"), F.lit(0)) <= 0).limit(1).count():
        raise ValueError("a run log has no history")
    steps = runs.select(
        F.col("tag").alias("run_id"), F.size("history").alias("n"),
        F.coalesce(F.col("summary.time_sec"), F.lit(0.0)).alias("total"),
        F.posexplode("history").alias("pos", "step"),
    )
    uniform = F.col("pos") * F.col("total") / F.greatest(F.col("n") - 1, F.lit(1))
    return steps.select("run_id", *(
        F.coalesce(F.col("step.t_sec"), uniform).alias("t_sec") if name == "t_sec" else F.col(f"step.{name}")
        for name in RUNS["history"].dataType.elementType.names
    ))


def finite_points(history: DataFrame) -> DataFrame:
    return history.where(tags.is_finite(F.col("t_sec")) & tags.is_finite(F.col("f")))


def read_thresholds(spark: SparkSession, pattern: str, one_per_file: bool = True) -> DataFrame:
    """Threshold records by run folder and tag; unreadable files, or none at all, give no record."""
    try:
        files = spark.read.schema(THRESHOLD).options(**_READ, multiLine=one_per_file).json(pattern)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        names = "dir string, tag string, metric string, best_threshold double, best_score double"
        return spark.createDataFrame([], names)
    found = files.select(F.col("_metadata.file_path").alias("path"), "*")
    return found.where(F.col("best_threshold").isNotNull()).select(
        tags.run_folder(F.col("path")).alias("dir"),
        F.regexp_replace(tags.run_tag(F.col("path")), "^threshold_", "").alias("tag"),
        *THRESHOLD.names,
    )


def read_timings(spark: SparkSession, pattern: str, one_per_file: bool = True) -> DataFrame:
    """Strategy timings as rows ``(strategy, iter, t_sec, f)``."""
    logs = spark.read.schema(TIMINGS).options(**_READ, multiLine=one_per_file).json(pattern)
    parts = []
    for strategy in ("map", "mappart"):
        pairs = F.arrays_zip(F.col(f"t_{strategy}").alias("t"), F.col(f"f_{strategy}").alias("f"))
        parts.append(
            logs.where(F.col(f"t_{strategy}").isNotNull())
            .select(F.posexplode(pairs).alias("pos", "x"))
            .select(F.lit(strategy).alias("strategy"), (F.col("pos") + 1).alias("iter"),
                    F.col("x.t").alias("t_sec"), F.col("x.f").alias("f"))
        )
    return parts[0].unionByName(parts[1])
