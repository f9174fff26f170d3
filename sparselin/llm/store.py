"""Intermediate tables and files in the folder that all executors share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparselin.session import scratch_path, ship_package


def give_back() -> None:
    """Return freed memory to the machine, where the C library can: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, task: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | T.StructType,
                slice_bytes: int = 1 << 22) -> DataFrame:
    """``mapInArrow`` over slices of about ``slice_bytes``, so a task's arrays stay small whatever the batch."""
    ship_package(df.sparkSession)

    names = df.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, slice_bytes):
                yield from task(part.rename_columns(names))
        # The last batch would stay with the worker as well.
        batch = part = None
        give_back()

    # Spark looks columns up by name here, and would take a dot in it for a path.
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes; a larger row is a slice of its own."""
    if batch.nbytes <= limit or batch.num_rows <= 1:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), limit)
    yield from slices(batch.slice(half), limit)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(df: DataFrame, keys: list[str], bound: int) -> DataFrame:
    """The ``bound`` rows of ``df`` with the least hashes of their distinct ``keys``; all if there are no more.

    Only the range of hashes that holds some twice as many is ordered, so no task gets more than that.
    """
    h = F.xxhash64(*keys)
    n = df.agg(F.approx_count_distinct(h)).first()[0]
    if n > 4 * bound:
        df = df.where(h < (2 * bound * (1 << 64)) // n - (1 << 63))
    return df.orderBy(h, *keys).limit(bound)


def input_bytes(df: DataFrame) -> int:
    """Bytes of what ``df`` is derived from, by the planner; sources of unknown size count nothing.

    The estimate of ``df`` itself is of no use here, since that of a join is a product.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


class Scratch:
    """Tables and files of one call under one folder of the shared store."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: it is computed once, and a lost executor costs a re-read."""
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path within it; for writers and readers in tasks."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def others(df: DataFrame, made: str) -> list[str]:
    """Columns of ``df`` but those an operator makes (a schema string); names are compared without case."""
    taken = {f.name.lower() for f in T.StructType.fromDDL(made)}
    return [c for c in df.columns if c.lower() not in taken]


def named(names: list[str]) -> list[Column]:
    """Columns by their literal names, dots and quotes included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def extended(df: DataFrame, names: list[str], made: str) -> T.StructType:
    """Schema of the named columns of ``df`` and those of a schema string."""
    return T.StructType([df.schema[n] for n in names] + T.StructType.fromDDL(made).fields)


def text_column(column: str = "text"):
    """A null text is an empty one."""
    return F.coalesce(F.col(column), F.lit("")).alias(column)
