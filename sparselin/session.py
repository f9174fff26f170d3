"""Where intermediate tables go and how large a broadcast may be."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Widest dense weight vector sent to every task: 2**24 doubles are 128 MiB.
MAX_BROADCAST_FEATURES = 1 << 24

# Largest table joined by broadcast, in rows of a few numbers each.
MAX_BROADCAST_ROWS = 1 << 20


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers of every executor import this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sparselin-ship-")) / "sparselin.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy per-record work on an input of a few files.

    Only an input with fewer partitions than cores is exchanged; a large one
    stays where its scan puts it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def map_in_arrow(df: DataFrame, task, schema) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(task, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Only a session that runs in one process may do without the setting and gets a
    fresh temporary folder; elsewhere a machine-local folder would be lost with
    its machine, so the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparselin-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once as Parquet and continue from the written table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """``df`` persisted and filled.

    The layout of a cache is known to the plans that read it once its own plan is final; before that they
    exchange what lies right already.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()
    return kept


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more; a session that has ended leaves it to the cluster's policy."""
    if spark.sparkContext._jsc is None:
        return
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class RotatingTable:
    """Successive versions of one table in three folders.

    An iteration that derives the next version from the last one writes it to
    another folder, so a lost executor can read its input again and storage stays
    bounded. A version that must outlive later ones is held.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = scratch_path(spark, name)
        self._paths = [f"{root}/{i}" for i in range(3)]
        self._last: str | None = None
        self._held: str | None = None

    def write(self, df: DataFrame) -> DataFrame:
        self._last = next(p for p in self._paths if p not in (self._last, self._held))
        return materialize(df, self._last)

    def hold(self) -> None:
        """Keep the last version, and release the one held before."""
        self._held = self._last


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; counts no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows
