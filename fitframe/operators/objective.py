"""The regularised objective and its gradient at given weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fitframe.examples import Examples
from fitframe.functions.losses import LOGISTIC, Loss
from fitframe.operators.vectors import completed
from fitframe.plans.evaluation import LOSS_ROW, Evaluation
from fitframe.plans.scoring import BROADCAST_FEATURES, scores_for


def initial_weights(spark: SparkSession, num_features: int, start: DataFrame | None = None) -> DataFrame:
    """``(idx, v)``: zeros, or the given start with missing features at 0."""
    if start is None:
        return spark.range(num_features).select(F.col("id").cast("int").alias("idx"), F.lit(0.0).alias("v"))
    return completed(start, num_features)


def evaluate(
    examples: Examples,
    weights: DataFrame,
    reg: float = 0.0,
    loss: Loss = LOGISTIC,
    broadcast_features: int = BROADCAST_FEATURES,
) -> DataFrame:
    """``(idx, v)``: the objective at ``LOSS_ROW`` and the gradient elsewhere.

    F = mean loss + reg/2 * |w|^2, gradient = mean derivative + reg * w. Both
    come from one pass over the cells.
    """
    examples = examples.validated()
    p = examples.num_features
    scores = scores_for(examples, broadcast_features)
    full = completed(weights, p)
    sums = Evaluation(scores, loss).sums(full)
    # The loss row's share of the penalty is reg/2 * |w|^2, a feature's reg * w.
    penalty = full.select("idx", (F.lit(reg) * F.col("v")).alias("penalty")).unionByName(
        full.agg(
            F.lit(LOSS_ROW).alias("idx"),
            (F.lit(reg / 2) * F.sum(F.col("v") * F.col("v"))).alias("penalty"),
        )
    )
    # Reads no column of the examples, for Parquet only the file footers.
    count = examples.df.agg(F.count(F.lit(1))).scalar()
    # Features that no example has are missing from the sums, not from the result.
    return penalty.join(sums, "idx", "left").select(
        "idx",
        (F.coalesce(F.col("total"), F.lit(0.0)) / count + F.col("penalty")).alias("v"),
    )


def objective(examples: Examples, weights: DataFrame, reg: float = 0.0, loss: Loss = LOGISTIC) -> DataFrame:
    """One row ``(examples, loss_sum, objective)``; no gradient is computed."""
    full = completed(weights, examples.num_features)
    scored = scores_for(examples.validated()).add({"z": full})
    squares = full.agg(F.sum(F.col("v") * F.col("v"))).scalar()
    totals = scored.agg(
        F.count(F.lit(1)).alias("examples"),
        F.sum(loss.value(F.col("label"), F.col("z"))).alias("loss_sum"),
    )
    return totals.select(
        "examples",
        "loss_sum",
        (F.col("loss_sum") / F.col("examples") + F.lit(reg / 2) * squares).alias("objective"),
    )


def gradient(
    examples: Examples,
    weights: DataFrame,
    reg: float = 0.0,
    loss: Loss = LOGISTIC,
    broadcast_features: int = BROADCAST_FEATURES,
) -> DataFrame:
    """``(idx, v)``, a row for every feature."""
    everything = evaluate(examples, weights, reg, loss, broadcast_features)
    return everything.where(F.col("idx") != LOSS_ROW)
