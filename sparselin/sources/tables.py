"""Examples and run logs derived from ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparselin.functions.text import binary_label, sum_repeated

# Event types that count as the positive class.
POSITIVE_EVENTS = ("purchase", "signup")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_lines(events: DataFrame) -> DataFrame:
    """One LIBSVM line per event: a valued feature from ``props.k``, an indicator from the user."""
    sign = F.when(F.col("event_type").isin(*POSITIVE_EVENTS), F.lit("+1")).otherwise(F.lit("-1"))
    k = F.get_json_object("props", "$.k").cast("int") + 1
    return events.select(
        F.col("event_id").alias("row_id"),
        F.concat(
            sign, F.lit(" "), k.cast("string"), F.lit(":"), F.col("value").cast("decimal(18,2)").cast("string"),
            F.lit(" "), (F.col("user_id") % 100 + 1).cast("string"), F.lit(":1"),
        ).alias("value"),
    )


def embedding_rows(embeddings: DataFrame) -> DataFrame:
    """Dense vectors as ROWS; odd labels are the positive class."""
    values = F.col("embedding").cast("array<double>")
    return embeddings.select(
        F.col("vec_id").alias("row_id"),
        binary_label(F.col("label") % 2).alias("label"),
        F.sequence(F.lit(0).cast("bigint"), F.size("embedding").cast("bigint") - 1).alias("indices"),
        values.alias("values"),
    )


def document_rows(documents: DataFrame, labels: DataFrame, target: str = "quality", width: int = 64) -> DataFrame:
    """Labelled documents by word length: feature j counts the words of j characters, the last one all longer."""
    one_each = F.transform(F.split("text", r"\s+"), lambda t: F.struct(
        F.least(F.length(t), F.lit(width - 1)).cast("bigint").alias("j"), F.lit(1.0).alias("v")))
    words = documents.join(labels, "doc_id").select(
        F.col("doc_id").alias("row_id"), binary_label(F.col(target)).alias("label"),
        F.sort_array(one_each).alias("_pairs"))
    counted = words.select("row_id", "label", sum_repeated(F.col("_pairs")).alias("_pairs"))
    return counted.select(
        "row_id", "label", F.col("_pairs")["j"].alias("indices"), F.col("_pairs")["v"].alias("values"))


def event_history(events: DataFrame) -> DataFrame:
    """Events as iteration records: one run per user, the event id as iteration number."""
    tag = F.concat(
        F.when(F.col("user_id") % 2 == 0, F.lit("lr")).otherwise(F.lit("l2svm")),
        F.lit("_C1e"), (F.col("user_id") % 5 - 3).cast("string"),
        F.lit("_eps1e-3_bias-1_rep"), (F.col("user_id") % 3 + 1).cast("string"),
    )
    return events.select(
        F.col("user_id").cast("string").alias("run_id"),
        tag.alias("tag"),
        F.col("event_id").alias("iter"),
        (F.col("ts").cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz"))
        .cast("interval second").cast("decimal(20,6)").cast("double").alias("t_sec"),
        F.col("value").alias("f"),
        F.get_json_object("props", "$.k").cast("double").alias("g_norm"),
    )
