"""Seeded shuffles and splits of an exact size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparselin.session import materialize, scratch_path

# Hex digits by which a prefix grows, the digits of a hash, and records ranked in one task at most.
PREFIX_DIGITS = 4
HASH_DIGITS = 32
RANKED = 1 << 20


def seeded_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def seeded_order(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """The records in a reproducible random order."""
    return df.orderBy(seeded_hash(key, seed), key)


def _cut(keys: DataFrame, key: str, ratio: float, seed: int) -> tuple | None:
    """Of the last record of the first ``int(ratio * n)``: hash, key, and which of the records with that key it is, from 1.

    None if there is no such record. Counts per hash prefix find the prefix that contains the cut. It is refined by
    more digits until few enough records share it, and a ranking of the keys that are left finds
    the one with the cut. Records with one whole hash are copies of one key, or as good as never met.
    """
    hashed = keys.select(seeded_hash(key, seed).alias("h"), F.col(key).alias("k"))
    prefix, wanted, digits = "", None, 0
    while True:
        digits += PREFIX_DIGITS
        here = hashed.where(F.col("h").startswith(prefix)).withColumn("b", F.substring("h", 1, digits))
        # At most 16**PREFIX_DIGITS records, so these windows are small.
        everything = Window.partitionBy(F.lit(0))
        upto = everything.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        sizes = here.groupBy("b").agg(F.count("*").alias("n")).select(
            "b", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(everything).alias("all"))
        target = F.floor(F.lit(float(ratio)) * F.col("all").cast("double")) if wanted is None else F.lit(wanted)
        before = F.col("upto") - F.col("n")
        found = sizes.where((before < target) & (target <= F.col("upto"))).select(
            "b", "n", (target - before).alias("rank")).first()
        if found is None:
            return None
        prefix, wanted = found["b"], found["rank"]
        if found["n"] <= RANKED or digits >= HASH_DIGITS:
            break
    # A key is one row here, however many copies it has.
    copies = here.where(F.col("b") == prefix).groupBy("h", "k").agg(F.count("*").alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy("h", "k").rowsBetween(Window.unboundedPreceding, 0)
    upto = copies.withColumn("upto", F.sum("n").over(order)).where((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted)).first()
    return upto["h"], upto["k"], wanted - (upto["upto"] - upto["n"]), upto["n"]


# The scan position of a record, and the partition it is in.
AT, PART_BITS = "_at", 33


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumn(AT, F.monotonically_increasing_id())


def _last_copy(df: DataFrame, key: str, cut: tuple | None) -> int | None:
    """The scan position of the copy of the cut's key that is the last one before the cut; None if all copies are."""
    if cut is None or cut[2] == cut[3]:
        return None
    same = df.where(F.col(key).eqNullSafe(F.lit(cut[1]))).select(AT)
    # One row a partition.
    parts = same.groupBy(F.shiftright(AT, PART_BITS).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    left = cut[2]
    for row in parts:
        if left <= row["n"]:
            here = same.where(F.shiftright(AT, PART_BITS) == row["p"])
            return here.orderBy(AT).offset(int(left) - 1).limit(1).first()[AT]
        left -= row["n"]
    raise ValueError("the records moved between two scans; write them first")


def _is_first(key: str, seed: int, cut: tuple | None, last: int | None) -> Column:
    if cut is None:
        return F.lit(False)
    h, k = seeded_hash(key, seed), F.col(key)
    here = k.eqNullSafe(F.lit(cut[1]))
    copies = here if last is None else here & (F.col(AT) <= last)
    return (h < cut[0]) | ((h == cut[0]) & (copies | F.coalesce(k < F.lit(cut[1]), F.lit(False))))


def _keys(df: DataFrame, key: str) -> DataFrame:
    return materialize(df.select(key), scratch_path(df.sparkSession, "split-keys"))


def exact_split(
    df: DataFrame,
    key: str,
    ratio: float = 0.8,
    seed: int = 0,
    names: tuple[str, str] = ("train", "test"),
    column: str = "split",
) -> DataFrame:
    """Mark ``int(ratio * n)`` records with the first name and the rest with the second.

    The first part holds the records that come first in ``seeded_order``. Keys may repeat or be missing: of the copies
    of the key in which the cut falls, the first ones of the scan belong to the first part, so ``df`` must
    give the same records in the same partitions on every scan then, as files and written tables do. Only the keys are
    searched for the position of the cut; the records are compared with it in place, without a shuffle.
    """
    cut = _cut(_keys(df, key), key, ratio, seed)
    placed = _placed(df)
    first = _is_first(key, seed, cut, _last_copy(placed, key, cut))
    return placed.withColumn(column, F.when(first, F.lit(names[0])).otherwise(F.lit(names[1]))).drop(AT)


def three_way_split(
    df: DataFrame,
    key: str,
    ratio: float = 0.8,
    inner_ratio: float = 0.8,
    seed: int = 42,
    inner_seed: int = 7,
) -> DataFrame:
    """Train, validation and test: the training part of a first split is split again."""
    outer_cut = _cut(_keys(df, key), key, ratio, seed)
    placed = _placed(df)
    outer = _is_first(key, seed, outer_cut, _last_copy(placed, key, outer_cut))
    inside = materialize(placed.where(outer).select(key), scratch_path(df.sparkSession, "split-keys"))
    inner_cut = _cut(inside, key, inner_ratio, inner_seed)
    inner = _is_first(key, inner_seed, inner_cut, _last_copy(placed.where(outer), key, inner_cut))
    split = F.when(~outer, F.lit("test")).when(inner, F.lit("train")).otherwise(F.lit("val"))
    return placed.withColumn("split", split).drop(AT)
