"""Backtracking search for a step with sufficient decrease."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fitframe.functions.arrays import number, number_array
from fitframe.plans.evaluation import Evaluation

# Fixed values of the method.
SUFFICIENT_DECREASE = 1e-5
SHRINK = 0.5
SMALLEST_REJECTED = 1e-20

# Trial steps 1, 1/2, 1/4, ... down to the first below SMALLEST_REJECTED.
STEPS = [1.0]
while STEPS[-1] >= SMALLEST_REJECTED:
    STEPS.append(STEPS[-1] * SHRINK)

# After the full step is rejected, the next steps share one pass, then the rest.
FIRST_BATCH = 8


def acceptable(value: float, start: float, step: float, slope: float) -> bool:
    """Not above the required decrease. NaN passes, which ends the training."""
    return not value >= start + step * SUFFICIENT_DECREASE * slope


def losses_at_steps(
    evaluation: Evaluation,
    weights: DataFrame,
    direction: DataFrame,
    reg: float,
    steps: Sequence[float],
) -> DataFrame:
    """``(trial, value)``: the objective at weights + step * direction."""
    pairs = weights.join(direction.withColumnRenamed("v", "d"), "idx")
    squares = pairs.agg(
        F.expr("struct(sum(v * v) AS ww, sum(v * d) AS wd, sum(d * d) AS dd)")
    ).scalar()
    totals = evaluation.losses_along(weights, direction, steps)
    step = f"element_at({number_array(steps)}, trial + 1)"
    return totals.select(
        "trial", F.expr(f"{step} AS step"), F.expr("total / examples AS mean"), squares.alias("sq")
    ).selectExpr(
        "trial",
        "step",
        f"mean + {number(reg / 2)} * (sq.ww + 2 * step * sq.wd + step * step * sq.dd) AS value",
    )


def first_acceptable(
    evaluation: Evaluation,
    weights: DataFrame,
    direction: DataFrame,
    reg: float,
    start: float,
    slope: float,
    steps: Sequence[float] = STEPS[1:],
) -> tuple[int, float] | None:
    """The largest acceptable step as (position in ``steps``, step), or None."""
    batches = [(0, steps[:FIRST_BATCH]), (FIRST_BATCH, steps[FIRST_BATCH:])]
    for offset, batch in batches:
        if not batch:
            continue
        rows = losses_at_steps(evaluation, weights, direction, reg, batch).collect()
        for row in sorted(rows, key=lambda r: r["trial"]):
            if acceptable(row["value"], start, row["step"], slope):
                return offset + row["trial"], row["step"]
    return None
