"""Losses as functions of the margin ``m`` and the label ``y`` in {+1, -1}.

Each formula is written once against a small set of elementary functions, ``xp``:
``COLUMNS`` evaluates it as a Spark expression, ``numpy`` inside Arrow batches.
A loss needs its value, its first derivative (``residual``) and its second
derivative (``curvature``) in ``m``; every aggregation is derived from these.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from types import SimpleNamespace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(x):
    return x if isinstance(x, Column) else F.lit(float(x))


COLUMNS = SimpleNamespace(
    exp=F.exp,
    log1p=F.log1p,
    abs=F.abs,
    maximum=lambda a, b: F.greatest(_lit(a), _lit(b)),
    where=lambda cond, a, b: F.when(cond, _lit(a)).otherwise(_lit(b)),
)


def softplus(x, xp=COLUMNS):
    """log(1 + e^x) without overflow."""
    return xp.maximum(x, 0.0) + xp.log1p(xp.exp(-xp.abs(x)))


def sigmoid(x, xp=COLUMNS):
    """1 / (1 + e^-x) without overflow."""
    tail = xp.exp(-xp.abs(x))
    return xp.where(x >= 0, 1.0 / (1.0 + tail), tail / (1.0 + tail))


def hinge(m, y, xp=COLUMNS):
    return xp.maximum(1.0 - y * m, 0.0)


def is_active(m, y, xp=COLUMNS):
    """1 where the example lies strictly inside the margin, else 0."""
    return xp.where(1.0 - y * m > 0, 1.0, 0.0)


@dataclass(frozen=True)
class Loss:
    name: str
    value: Callable[..., Any]
    residual: Callable[..., Any]
    curvature: Callable[..., Any]


_LOSSES: dict[str, Loss] = {}


def register(loss: Loss) -> Loss:
    """Make a loss available to every objective, gradient and fit by its name."""
    _LOSSES[loss.name] = loss
    return loss


def get_loss(name: str) -> Loss:
    try:
        return _LOSSES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown solver {name!r}; known: {sorted(_LOSSES)}") from None


def logistic_value(m, y, xp=COLUMNS):
    return softplus(-y * m, xp)


def logistic_residual(m, y, xp=COLUMNS):
    return -y * sigmoid(-y * m, xp)


def logistic_curvature(m, y, xp=COLUMNS):
    p = sigmoid(-y * m, xp)
    return p * (1.0 - p)


def squared_hinge_value(m, y, xp=COLUMNS):
    h = hinge(m, y, xp)
    return h * h


def squared_hinge_residual(m, y, xp=COLUMNS):
    return 2.0 * is_active(m, y, xp) * (m - y)


def squared_hinge_curvature(m, y, xp=COLUMNS):
    return 2.0 * is_active(m, y, xp)


LOGISTIC = register(Loss("lr", logistic_value, logistic_residual, logistic_curvature))
SQUARED_HINGE = register(Loss("l2svm", squared_hinge_value, squared_hinge_residual, squared_hinge_curvature))
