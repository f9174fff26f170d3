"""LIBSVM and SVMlight text as ROWS."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparselin.functions import rows as R
from sparselin.functions import text as X
from sparselin.operators.prefix import running_totals
from sparselin.session import is_small, materialize, scratch_path

DIALECTS = ("libsvm", "svmlight")


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Raw lines. ``partitions`` is a minimum, reached by a shuffle when the scan has fewer."""
    lines = spark.read.text(path).select("value")
    if partitions and lines.rdd.getNumPartitions() < partitions:
        lines = lines.repartition(partitions)
    return lines


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the records 0..n-1 in scan order without moving them.

    Spark's monotonic id holds the partition in its upper bits; the sizes of the
    partitions (one small row each) give every partition its offset. ``df`` must
    give the same records in the same partitions on every scan, as file scans do.
    """
    numbered = df.withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    sizes = numbered.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).collect()
    offsets, total = {}, 0
    for row in sorted(sizes, key=lambda r: r["_p"]):
        offsets[row["_p"]] = total
        total += row["_n"]
    spark = df.sparkSession
    table = spark.createDataFrame(list(offsets.items()) or [(0, 0)], "_p bigint, _o bigint")
    return (
        numbered.withColumn("_p", part)
        .join(F.broadcast(table), "_p")
        .withColumn(name, F.col("_o") + F.col("_m").bitwiseAND((1 << 33) - 1))
        .drop("_p", "_o", "_m")
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, row_id)``: lines of a file or folder with their numbers from 0, files in the order of their paths.

    However files are split and packed into partitions, a line's number is that of its block's first line, found from the
    line counts of all blocks, and its place in the block. Lines stay where the scan puts them.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")).withColumn(
        "_m", F.monotonically_increasing_id())
    # A row a block. Within a block the ids ascend by one, since a task reads it in one go.
    blocks = lines.groupBy("_path", "_start").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    placed = running_totals(blocks.withColumn("_at", F.struct("_path", "_start")), "_at", {"_upto": "_n"})
    offsets = placed.select("_path", "_start", (F.col("_upto") - F.col("_n") - F.col("_first")).alias("_offset"))
    offsets = F.broadcast(offsets) if is_small(offsets) else offsets
    return lines.join(offsets, ["_path", "_start"]).select("value", (F.col("_m") + F.col("_offset")).alias("row_id"))


def parse(lines: DataFrame, dialect: str = "libsvm", value: str = "value", row_id: str | None = "row_id") -> DataFrame:
    """Parse a text column into ROWS; unusable lines are dropped.

    ``libsvm`` maps labels to +1/-1 and treats a bad label as negative,
    ``svmlight`` keeps raw labels and drops lines without a plain numeric one.
    Without a ``row_id`` column the result has label and features only.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}; known: {DIALECTS}")
    key = [row_id] if row_id else []
    usable, to_label = (
        (X.is_data_line, X.lenient_label) if dialect == "libsvm" else (X.has_strict_label, X.strict_label))
    # The filter is a match on the raw line, so that nothing of the parsing is done twice when it is pushed down.
    line = X.readable(F.col(value))
    words = lines.where(usable(line)).select(*key, X.tokens(line).alias("_words")).withColumn(
        "label", to_label(F.get("_words", F.lit(0))))
    pairs = words.select(
        *key, "label",
        F.sort_array(X.feature_pairs(F.slice("_words", 2, F.size("_words")))).alias("_pairs"),
    )
    merged = pairs.select(
        *key, "label",
        F.when(F.size("_pairs") < 2, F.col("_pairs")).otherwise(X.sum_repeated(F.col("_pairs"))).alias("_pairs"),
    )
    return merged.select(
        *(F.col(k).alias("row_id") for k in key), "label",
        F.col("_pairs")["j"].alias("indices"), F.col("_pairs")["v"].alias("values"),
    )


def feature_width(rows: DataFrame) -> int:
    """Largest feature id + 1; an input without rows is an error."""
    found = rows.agg(
        F.count("*").alias("n"),
        F.coalesce(F.max(F.array_max("indices")), F.lit(-1)).alias("top"),
    ).first()
    if found["n"] == 0:
        raise ValueError("no usable examples")
    return found["top"] + 1


def with_bias(rows: DataFrame, bias: float = -1.0, n_features: int | None = None) -> tuple[DataFrame, int]:
    """Append the bias column if ``bias >= 0`` and return the rows with their total width.

    ``n_features`` forces the total width, bias included; a feature that does not
    fit below it, or that would fall on the bias column, is an error. The error is
    raised by whatever reads the rows, so a known width costs no pass of its own.
    """
    has_bias = bias is not None and bias >= 0
    width = feature_width(rows) + has_bias if n_features is None else n_features
    room = width - has_bias
    if n_features is not None:
        message = f"a feature does not fit into {width} columns{' with a bias' if has_bias else ''}"
        fits = F.coalesce(F.array_max("indices"), F.lit(-1)) < room
        rows = rows.withColumn("indices", F.when(fits, F.col("indices")).otherwise(F.raise_error(F.lit(message))))
    if not has_bias:
        return rows, width
    indices, values = R.append_bias(F.col("indices"), F.col("values"), width - 1, bias)
    return rows.withColumns({"indices": indices, "values": values}), width


def read_libsvm(
    spark: SparkSession,
    path: str,
    bias: float = -1.0,
    n_features: int | None = None,
    partitions: int | None = None,
    dialect: str = "libsvm",
    store: bool = True,
) -> tuple[DataFrame, int]:
    """Read a file or folder: ROWS and the total number of features. Row ids are line numbers, files in the order of their paths.

    The parsed rows are written once to the shared folder, since finding the
    width and every later pass would parse the text again; ``store=False`` leaves
    them unwritten for a single pass over a known width.
    """
    lines = numbered_lines(spark, path)
    if partitions and lines.rdd.getNumPartitions() < partitions:
        lines = lines.repartition(partitions)
    rows = parse(lines, dialect)
    if store:
        rows = materialize(rows, scratch_path(spark, "rows"))
        if n_features is not None:
            feature_width(rows)  # an input without rows is an error with a forced width, too
    return with_bias(rows, bias, n_features)


def read_strict(spark: SparkSession, path: str, n_features: int | None = None) -> DataFrame:
    """Spark's own strict reader: ``label`` and an ML vector.

    Any irregular line is an error, and entries that are explicitly 0 are not stored.
    """
    reader = spark.read.format("libsvm")
    if n_features is not None:
        reader = reader.option("numFeatures", str(n_features))
    return reader.load(path)
