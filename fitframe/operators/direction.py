"""Quasi-Newton direction from matrices of correction pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fitframe.operators.matrix import DistributedMatrix
from fitframe.plans.history import PairHistory


def descent_direction(
    changes: DistributedMatrix, gradient_changes: DistributedMatrix, gradient: DataFrame
) -> DataFrame:
    """``(idx, v)``: minus the approximate inverse Hessian times the gradient.

    Column k of the two matrices is the k-th correction pair, oldest first.
    All pairs need positive curvature. Only the inner products of the columns
    come to the driver.
    """
    if changes.num_cols != gradient_changes.num_cols or changes.num_cols == 0:
        raise ValueError("both matrices need the same number of columns, at least one")
    everything = changes.concat(gradient_changes).append_column(gradient)
    history = PairHistory.from_gram(changes.num_cols, everything.gram().collect())
    bad = [k for k in range(history.num_pairs) if not history.curvature(k) > 0]
    if bad:
        raise ValueError(f"pairs {bad} have no positive curvature")
    return everything.right_multiply(history.quasi_newton())
