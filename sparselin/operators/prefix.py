"""Running totals over a global order without sending everything to one task.

The records are written once and counted. Up to ``RANGE_ROWS`` of them are summed by one sort. More are
range-partitioned by the order into as many ranges as their number asks for, whatever the session's partitions. Totals
per range are a small table whose prefix sums become offsets, themselves found in this way where there are too many,
and the exact running total is computed inside each range. The cuts only balance the ranges; they do not affect
the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparselin.session import MAX_BROADCAST_ROWS, delete, materialize, scratch_path

# Records of a range, about.
RANGE_ROWS = 1 << 20


def bucketed(df: DataFrame, order: str, by: Sequence[str], buckets: int) -> DataFrame:
    """``df`` in ranges of the order, numbered by ``_bucket``."""
    return df.repartitionByRange(buckets, *by, order).withColumn("_bucket", F.spark_partition_id().cast("long"))


def _inside(sums: Mapping[str, str], window) -> dict[str, Column]:
    return {name: F.sum(c).over(window) for name, c in sums.items()}


def running_totals(
    df: DataFrame,
    order: str,
    sums: Mapping[str, str],
    by: Sequence[str] = (),
    totals: Mapping[str, str] | None = None,
    range_rows: int | None = None,
) -> DataFrame:
    """``df`` with inclusive running sums.

    ``sums`` maps an output name to the column it accumulates in ascending
    ``order`` within ``by``; ``totals`` maps an output name to a column whose
    overall sum per ``by`` is added to every record. Within ``by`` the values of
    ``order`` must be distinct: aggregate equal values first. Keys in ``by`` may
    be of any size, since a large one is spread over the ranges.

    The ranges are written to the shared folder and read twice, for their totals and for the result: what leads to
    them runs once, and a range stays what it was if a task is repeated.
    """
    spark, by, totals = df.sparkSession, list(by), dict(totals or {})
    limit = RANGE_ROWS if range_rows is None else range_rows
    path = scratch_path(spark, "running-totals")
    written = materialize(df, path)
    key = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    # From the files' footers.
    ranges = -(-written.count() // limit)
    if ranges <= 1:
        # One sort of a bounded table.
        upto = key.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return written.withColumns(_inside(sums, upto) | {name: F.sum(c).over(key) for name, c in totals.items()})

    placed = materialize(bucketed(written, order, by, ranges), scratch_path(spark, "running-totals"))
    delete(spark, path)
    needed = sorted({*sums.values(), *totals.values()})
    sizes = placed.groupBy(*by, "_bucket").agg(*(F.sum(c).alias(f"_s_{c}") for c in needed))
    befores = {f"_before_{name}": f"_s_{c}" for name, c in sums.items()}
    wholes = {name: f"_s_{c}" for name, c in totals.items()}
    if ranges > limit:
        # The table of ranges is too long for one sort as well.
        upto = running_totals(sizes.withColumnRenamed("_bucket", "_range"), "_range", befores, by, wholes, limit)
        offsets = upto.select(*by, F.col("_range").alias("_bucket"), *((F.col(n) - F.col(c)).alias(n) for n, c in befores.items()), *wholes)
    else:
        # A key has a record for each range it lies in; all of them are at most the keys and the ranges together.
        before = key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select(
            *by, "_bucket", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in befores.items()),
            *(F.sum(c).over(key).alias(n) for n, c in wholes.items()))
    # Without keys the offsets are one record a range; with keys AQE decides.
    near = not by and ranges <= MAX_BROADCAST_ROWS
    located = placed.join(F.broadcast(offsets) if near else offsets, [*by, "_bucket"], "left")
    upto = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return located.withColumns({
        name: F.col(f"_before_{name}") + total for name, total in _inside(sums, upto).items()
    }).drop("_bucket", *befores)
