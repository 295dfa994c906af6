"""Correction pairs of the quasi-Newton method and the direction they give.

The vectors live in the state table, one row per feature:

    idx int, w double, g double, s array<double>, t array<double>

``w`` is the iterate, ``g`` the gradient, and position k of ``s`` and ``t`` the
k-th pair held, oldest first: change of the iterate and change of the gradient.
Every direction is a combination of ``s``, ``t`` and ``g``, so its coefficients
follow from the inner products of those columns alone. Only these products and
coefficients, a few hundred numbers, are on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

from fitframe.functions.arrays import number
from fitframe.plans.evaluation import LOSS_ROW


# The vectors that directions are made of, as one array per feature.
BASIS = "concat(s, t, array(g))"


def combine(coefficients: np.ndarray) -> str:
    """One combination of the basis, row by row.

    Written out term by term: three times as fast as array lambdas.
    """
    pairs = len(coefficients) // 2
    vectors = [f"{name}[{k}]" for name in ("s", "t") for k in range(pairs)] + ["g"]
    terms = [f"{number(float(c))} * {v}" for c, v in zip(coefficients, vectors)]
    return f"({' + '.join(terms)})"


def newest_products(pairs: int) -> list[Column]:
    """Sums over the state's rows, to be observed as it is written: ``pairs`` pairs are held.

    Products of each basis vector with the newest pair and with the gradient, by name
    and place; that of the iterate with itself; and at ``LOSS_ROW`` the summed loss. The
    products of older vectors among themselves are known from earlier steps.
    """
    vectors = [f"{name}[{k}]" for name in ("s", "t") for k in range(pairs)] + ["g"]
    newest = {"g": "g"} | ({"s": f"s[{pairs - 1}]", "t": f"t[{pairs - 1}]"} if pairs else {})
    feature = lambda product: F.expr(f"sum(if(idx = {LOSS_ROW}, 0D, {product}))")
    products = [
        feature(f"{v} * {other}").alias(f"{name}_{place}")
        for place, v in enumerate(vectors) for name, other in newest.items()
    ]
    return [*products, feature("w * w").alias("squares"), F.expr(f"sum(if(idx = {LOSS_ROW}, g, 0D))").alias("loss")]


class PairHistory:
    """Inner products of the basis, kept up to date as pairs come and go."""

    def __init__(self, limit: int):
        self.limit = limit
        self.num_pairs = 0
        # Products among s_0 .. s_k-1, t_0 .. t_k-1, g, in this order.
        self.products = np.zeros((1, 1))

    @staticmethod
    def at_start(limit: int, gradient_squared: float) -> "PairHistory":
        history = PairHistory(limit)
        history.products = np.array([[gradient_squared]])
        return history

    @staticmethod
    def from_gram(num_pairs: int, rows: list) -> "PairHistory":
        """From the products ``(i, j, v)`` of all columns of [S | T | g]."""
        history = PairHistory(num_pairs)
        history.num_pairs = num_pairs
        history.products = np.zeros((2 * num_pairs + 1, 2 * num_pairs + 1))
        for row in rows:
            history.products[row["i"], row["j"]] = row["v"]
            history.products[row["j"], row["i"]] = row["v"]
        return history

    def extended(self, newest: dict[str, float]) -> "PairHistory":
        """The history after a step, from that step's ``newest_products``."""
        kept = min(self.num_pairs, self.limit - 1)
        dropped = self.num_pairs - kept
        k = kept + 1
        known = [*range(dropped, self.num_pairs)]
        known += [self.num_pairs + i for i in known]
        places = [*range(kept), *range(k, k + kept)]

        result = PairHistory(self.limit)
        result.num_pairs = k
        result.products = np.zeros((2 * k + 1, 2 * k + 1))
        result.products[np.ix_(places, places)] = self.products[np.ix_(known, known)]
        for name, place in (("s", k - 1), ("t", 2 * k - 1), ("g", 2 * k)):
            for other in range(2 * k + 1):
                result.products[other, place] = result.products[place, other] = newest[f"{name}_{other}"]
        return result

    def curvature(self, pair: int) -> float:
        """s . t of a pair."""
        return float(self.products[pair, self.num_pairs + pair])

    def steepest(self, scale: float) -> np.ndarray:
        """Coefficients of -scale * gradient."""
        coefficients = np.zeros(2 * self.num_pairs + 1)
        coefficients[-1] = -scale
        return coefficients

    def quasi_newton(self) -> np.ndarray:
        """Coefficients of minus the approximate inverse Hessian times gradient.

        The two-loop recursion, run on coefficients: subtracting a multiple of a
        basis vector changes one coefficient, and a product with a basis vector
        is a product with a row of the inner products.
        """
        k, gram = self.num_pairs, self.products
        q = self.steepest(1.0)
        weight = np.zeros(k)
        for pair in reversed(range(k)):
            weight[pair] = gram[pair] @ q / self.curvature(pair)
            q[k + pair] -= weight[pair]
        newest = k - 1
        q *= self.curvature(newest) / gram[k + newest, k + newest]
        for pair in range(k):
            correction = gram[k + pair] @ q / self.curvature(pair)
            q[pair] += weight[pair] - correction
        return q

    def slope(self, coefficients: np.ndarray) -> float:
        """Gradient . direction."""
        return float(self.products[-1] @ coefficients)
