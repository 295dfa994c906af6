"""Losses as pairs of column expressions.

A loss is two functions of (label, linear score): the loss itself and its
derivative by the score (the residual). The training plans take any such pair.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _log_loss(y: Column, z: Column) -> Column:
    # Finite for every finite score: exp only ever sees non-positive numbers.
    return F.greatest(z, F.lit(0.0)) - y * z + F.log1p(F.exp(-F.abs(z)))


def _log_residual(y: Column, z: Column) -> Column:
    return sigmoid(z) - y


@dataclass(frozen=True)
class Loss:
    value: Callable[[Column, Column], Column]
    residual: Callable[[Column, Column], Column]


LOGISTIC = Loss(value=_log_loss, residual=_log_residual)
