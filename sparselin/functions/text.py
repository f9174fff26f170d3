"""Column expressions that turn a LIBSVM or SVMlight line into features.

A line is ``<label> <index>:<value> ...`` with 1-based indices. The grammar is
tolerant: comments, unknown tokens, zero indices and bad values are dropped, and
repeated indices are summed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that separate tokens, and the accepted numbers.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
INTEGER = r"[+-]?\d+"
DECIMAL = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
NON_FINITE = r"[+-]?(?i:nan|inf|infinity)"
NUMBER = f"(?:{DECIMAL}|{NON_FINITE})"
STRICT_LABEL = r"-?(?:\d+\.?\d*|\.\d+)"


def readable(value: Column) -> Column:
    """Drop bytes that are not UTF-8, keep everything else."""
    return F.coalesce(
        F.try_validate_utf8(value), F.replace(F.make_valid_utf8(value), F.lit("\ufffd"), F.lit("")))


def is_data_line(value: Column) -> Column:
    """Neither blank nor a comment line: it starts, after spaces, with something else than ``#``."""
    return value.rlike(f"^{SPACE}*(?!{SPACE})[^#]")


def has_strict_label(value: Column) -> Column:
    """The line starts with a plain number."""
    return value.rlike(f"^{SPACE}*{STRICT_LABEL}(?:{SPACE}|#|$)")


def tokens(line: Column) -> Column:
    """What stands before a comment, split at spaces."""
    return F.array_remove(F.split(F.substring_index(line, "#", 1), f"{SPACE}+"), "")


def number(token: Column) -> Column:
    """The value of a numeric token, null for anything else."""
    return F.when(token.rlike(f"^{NUMBER}$"), token.try_cast("double"))


def is_positive(x: Column) -> Column:
    # NaN sorts above every number in Spark, so it needs its own test.
    return (x > 0) & ~F.isnan(x)


def binary_label(x: Column, negative: float = -1.0) -> Column:
    """+1 for a positive number, ``negative`` for everything else."""
    return F.when(is_positive(x), F.lit(1.0)).otherwise(F.lit(float(negative)))


def lenient_label(token: Column) -> Column:
    """+1/-1 label; a token that is not a number counts as negative."""
    return binary_label(F.coalesce(number(token), F.lit(-1.0)))


def strict_label(token: Column) -> Column:
    """The raw label: plain digits with an optional minus and point, else null."""
    return F.when(token.rlike(f"^{STRICT_LABEL}$"), token.try_cast("double"))


def feature_pairs(feature_tokens: Column) -> Column:
    """``array<struct<j, v>>`` of the well-formed tokens, 0-based, in line order."""
    well_formed = F.filter(feature_tokens, lambda t: t.rlike(f"^{INTEGER}:{NUMBER}$"))
    pairs = F.transform(well_formed, lambda t: F.struct(
        (F.substring_index(t, ":", 1).try_cast("bigint") - 1).alias("j"),
        F.substring_index(t, ":", -1).try_cast("double").alias("v"),
    ))
    return F.filter(pairs, lambda e: e["j"] >= 0)


def sum_repeated(sorted_pairs: Column) -> Column:
    """Add up neighbours with an equal ``j``; the input is sorted by ``j``.

    Group borders come from one scan and every group is sliced once, so a long
    line with many repetitions stays linear.
    """
    size = F.size(sorted_pairs)
    starts = F.filter(
        F.sequence(F.lit(0), size - 1),
        lambda i: (i == 0) | (F.get(sorted_pairs, i)["j"] != F.get(sorted_pairs, i - 1)["j"]),
    )
    ends = F.concat(F.slice(starts, 2, size), F.array(size))
    merged = F.zip_with(starts, ends, lambda s, e: F.struct(
        F.get(sorted_pairs, s)["j"].alias("j"),
        F.aggregate(F.slice(sorted_pairs, s + 1, e - s), F.lit(0.0), lambda acc, x: acc + x["v"]).alias("v"),
    ))
    distinct = F.size(F.array_distinct(sorted_pairs["j"]))
    return F.when(distinct == size, sorted_pairs).otherwise(merged)


def encode_line(label: Column, indices: Column, values: Column) -> Column:
    """The LIBSVM line of one example."""
    sign = F.when(is_positive(label), F.lit("+1")).otherwise(F.lit("-1"))
    pairs = F.zip_with(indices, values, lambda j, v: F.concat_ws(":", (j + 1).cast("string"), v.cast("string")))
    return F.concat_ws(" ", F.concat(F.array(sign), pairs))
