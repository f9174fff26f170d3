"""Expressions over the ``indices``/``values`` arrays of one example."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# An inline weight array is part of the plan, so it must stay narrow.
MAX_INLINE_FEATURES = 4096


def append_bias(indices: Column, values: Column, column: Column | int, bias: float) -> tuple[Column, Column]:
    """The arrays with one more entry ``bias`` in feature ``column``; 0.0 is stored too."""
    position = column if isinstance(column, Column) else F.lit(column)
    return (
        F.concat(indices, F.array(position.cast("bigint"))),
        F.concat(values, F.array(F.lit(float(bias)))),
    )


def inline_dot(indices: Column, values: Column, weights: Sequence[float]) -> Column:
    """The margin of one example against a narrow model; features beyond it count 0."""
    if len(weights) > MAX_INLINE_FEATURES:
        raise ValueError(f"{len(weights)} weights are too many for an inline array; use margins()")
    w = F.lit([float(x) for x in weights])
    products = F.zip_with(indices, values, lambda j, v: v * F.coalesce(F.get(w, j.cast("int")), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def densify(indices: Column, values: Column, n_features: Column | int) -> Column:
    """The example as a dense array, of ``n_features`` numbers a row. For looking at rows, not for computing.

    Each entry brings the zeros before it, so a row takes one pass; indices ascend.
    """
    width = (n_features if isinstance(n_features, Column) else F.lit(n_features)).cast("int")

    def zeros(n: Column) -> Column:
        return F.array_repeat(F.lit(0.0), F.greatest(n.cast("int"), F.lit(0)))

    runs = F.transform(indices, lambda j, i: F.concat(
        zeros(j - F.coalesce(F.get(indices, i - 1), F.lit(-1)) - 1), F.array(F.get(values, i))))
    tail = zeros(width - 1 - F.coalesce(F.element_at(F.when(F.size(indices) > 0, indices), -1), F.lit(-1)))
    cells = F.slice(F.concat(F.flatten(runs), tail), F.lit(1), width)
    # Naming the arrays outside the lambda as well keeps Spark from evaluating what produces them per cell.
    return F.when(F.size(indices) == F.size(values), cells)


def decide(margin: Column, threshold: Column | float = 0.0) -> Column:
    """Predicted class: +1 from the threshold upwards, otherwise -1; NaN is negative."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when((margin >= cut) & ~F.isnan(margin), F.lit(1.0)).otherwise(F.lit(-1.0))
