"""Sums over all examples: loss, gradient, and losses along a direction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fitframe.functions.arrays import number_array
from fitframe.functions.losses import Loss
from fitframe.plans.scoring import SHORT_FEATURES, BroadcastScores, JoinScores

# Index under which an evaluation reports the summed loss and, as its number
# of cells, the number of examples.
LOSS_ROW = -1


class Evaluation:
    def __init__(self, scores: BroadcastScores | JoinScores, loss: Loss):
        self.scores = scores
        self._loss = loss
        y, z = F.col("label"), F.col("z")
        self._per_example = [loss.residual(y, z).alias("residual"), loss.value(y, z).alias("loss")]
        if scores.examples.is_sparse:
            self._inputs = ["indices", "values"]
            marked = f"concat(indices, array({LOSS_ROW})), concat(values, array(0D))"
            self._cells = f"inline(arrays_zip({marked})) AS (idx, v)"
        else:
            self._inputs = ["values"]
            self._cells = "posexplode(concat(array(0D), values)) AS (pos, v)"

    def sums(self, weights: DataFrame) -> DataFrame:
        """``(idx, total, cells)`` at weights ``(idx, v)``.

        ``total`` is the summed derivative of the loss by each weight, at
        ``LOSS_ROW`` the summed loss; one pass over the data returns all. The
        sums combine inside each partition before the shuffle, so a feature
        that every example has sends one row per partition.
        """
        scored = self.scores.add({"z": weights})
        if not self.scores.examples.is_sparse and self.scores.examples.num_features <= SHORT_FEATURES:
            return self._short_sums(scored)
        cells = scored.select(*self._per_example, *self._inputs).selectExpr(
            "residual", "loss", self._cells
        )
        # The dense marker is position 0, so dense positions run one ahead.
        idx = "idx" if self.scores.examples.is_sparse else f"pos + {LOSS_ROW}"
        part = f"if({idx} = {LOSS_ROW}, loss, residual * v)"
        return cells.groupBy(F.expr(f"{idx} AS idx")).agg(
            F.expr(f"sum({part}) AS total"), F.expr("count(1) AS cells")
        )

    def _short_sums(self, scored: DataFrame) -> DataFrame:
        """For few dense features a sum for each, written out: no row is formed per cell."""
        p = self.scores.examples.num_features
        parts = scored.select(*self._per_example, "values")
        sums = [f"sum(residual * get(values, {i})) AS g{i}" for i in range(p)]
        row = parts.selectExpr("count(1) AS n", "sum(loss) AS total", *sums).where("n > 0")
        cells = [f"struct({LOSS_ROW} AS idx, total, n AS cells)"]
        cells += [f"struct({i} AS idx, g{i} AS total, n AS cells)" for i in range(p)]
        return row.selectExpr(f"inline(array({', '.join(cells)}))")

    def losses_along(
        self, weights: DataFrame, direction: DataFrame, steps: Sequence[float]
    ) -> DataFrame:
        """``(trial, total, examples)``: summed loss at weights + step * direction.

        Scores are linear in the step, so one pass serves all steps.
        """
        scored = self.scores.add({"z": weights, "dz": direction})
        trials = scored.selectExpr(
            "label", "z", "dz", f"posexplode({number_array(steps)}) AS (trial, step)"
        )
        value = self._loss.value(F.col("label"), F.expr("z + step * dz"))
        return trials.groupBy("trial").agg(
            F.sum(value).alias("total"), F.expr("count(1) AS examples")
        )
