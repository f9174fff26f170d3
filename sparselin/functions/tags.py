"""Names and defaults read from run logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parts of a run tag, e.g. lr_C1e-3_eps1e-4_bias-1_rep2.
LOG_PREFIX = "metrics_"
SOLVERS = ("lr", "l2svm")
REPETITION = r"_rep\d+$"
C_IN_TAG = r"C([0-9e.-]+)"
NO_BIAS = r"_bias-1$"


def run_tag(path: Column) -> Column:
    """File name without folder, extension and log prefix."""
    name = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.replace(name, F.lit(LOG_PREFIX), F.lit(""))


def run_folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_tag(tag: Column) -> Column:
    """The configuration a repetition belongs to."""
    return F.regexp_replace(tag, REPETITION, "")


def solver_name(configured: Column, tag: Column) -> Column:
    """The configured solver, else the tag's prefix, else ``?``."""
    by_prefix = F.lit("?")
    for solver in SOLVERS:
        by_prefix = F.when(tag.startswith(f"{solver}_"), F.lit(solver)).otherwise(by_prefix)
    return F.coalesce(F.nullif(configured, F.lit("")), by_prefix)


def c_from_tag(tag: Column) -> Column:
    """The number after ``C``, 0 if the tag has none; used to order groups."""
    found = F.nullif(F.regexp_extract(tag, C_IN_TAG, 1), F.lit(""))
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def short_label(tag: Column) -> Column:
    """The tag without solver prefix and without the suffix of a bias-free run."""
    prefixes = "|".join(f"{solver}_" for solver in SOLVERS)
    return F.regexp_replace(F.regexp_replace(tag, f"^(?:{prefixes})", ""), NO_BIAS, "")


def or_nan(x: Column) -> Column:
    return F.coalesce(x, F.lit(float("nan")))


def nan_as_null(x: Column) -> Column:
    """Let built-in aggregates skip NaN the way they skip null."""
    return F.when(~F.isnan(x), x)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def reg_param(C: float, n_rows: int) -> float:
    """Penalty of a mean-loss objective that equals the C-weighted sum."""
    return 1.0 / (C * n_rows)


def utc_stamp(moment: Column | None = None) -> Column:
    """A moment, by default now, as text in UTC."""
    now = F.to_utc_timestamp(F.current_timestamp() if moment is None else moment, F.current_timezone())
    return F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
