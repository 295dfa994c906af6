"""Scores of a fitted model. The model is its ``(idx, v)`` weights, no intercept."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fitframe.examples import Examples
from fitframe.functions.losses import sigmoid
from fitframe.operators.vectors import completed
from fitframe.plans.scoring import BROADCAST_FEATURES, scores_for


def linear_scores(
    examples: Examples, weights: DataFrame, broadcast_features: int = BROADCAST_FEATURES
) -> DataFrame:
    """The examples plus ``z``, their dot product with the weights."""
    full = completed(weights, examples.num_features)
    return scores_for(examples, broadcast_features).add({"z": full})


def score(
    examples: Examples,
    weights: DataFrame,
    threshold: float | None = None,
    broadcast_features: int = BROADCAST_FEATURES,
) -> DataFrame:
    """The examples plus ``score``, the probability of label 1.

    With a threshold also ``prediction``: 1.0 above it, 0.0 at or below.
    """
    scored = linear_scores(examples, weights, broadcast_features)
    scored = scored.withColumn("score", sigmoid(F.col("z"))).drop("z")
    if threshold is None:
        return scored
    return scored.withColumn("prediction", (F.col("score") > F.lit(threshold)).cast("double"))
