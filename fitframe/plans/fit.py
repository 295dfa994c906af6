"""Training: a driver loop over scalars, with all vectors in tables.

Each step evaluates the data once and writes one state table (see
``fitframe.plans.history`` for its columns). The inner products that decide the next
direction are observed in the tasks that write it. State tables are bucketed by feature,
all alike: a step's sums are shuffled to where the state is, and the state never is.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from fitframe.examples import Examples
from fitframe.functions.arrays import number
from fitframe.functions.losses import LOGISTIC, Loss
from fitframe.operators.objective import initial_weights
from fitframe.plans.evaluation import LOSS_ROW, Evaluation
from fitframe.plans.history import PairHistory, combine, newest_products
from fitframe.plans.linesearch import acceptable, first_acceptable
from fitframe.plans.scoring import BROADCAST_FEATURES, scores_for
from fitframe.plans.scratch import Scratch, StoredTable

# Fixed values of the method: steepest-descent steps before the first
# quasi-Newton direction, and the share of the gradient they follow.
WARM_STEPS = 3
WARM_SCALE = 0.5

PARTITIONS_SETTING = "spark.sql.shuffle.partitions"
FEATURES_OF_A_BLOCK = 1 << 16

log = logging.getLogger("fitframe")

TRACE_SCHEMA = T.StructType(
    [
        T.StructField("iter", T.IntegerType(), False),
        T.StructField("objective", T.DoubleType()),
        T.StructField("improvement", T.DoubleType()),
        T.StructField("step", T.DoubleType()),
        T.StructField("trials", T.IntegerType(), False),
        T.StructField("curvature", T.DoubleType()),
        T.StructField("accepted", T.BooleanType(), False),
    ]
)


@dataclass(frozen=True)
class FittedModel:
    """``weights (idx, v)``, the objective there, and how training went.

    ``stop_reason`` is one of ``max_iterations``, ``converged``,
    ``not_descent``, ``step_underflow``, ``bad_curvature``, ``nan_objective``.
    """

    weights: DataFrame
    objective: float
    stop_reason: str
    steps: list[tuple] = field(repr=False)

    @property
    def num_steps(self) -> int:
        """Accepted steps."""
        return sum(step[-1] for step in self.steps) - 1

    @property
    def trace(self) -> DataFrame:
        """``(iter, objective, improvement, step, trials, curvature, accepted)``.

        ``curvature`` is the product of the step's two changes, iterate and
        gradient. Row 0 is the start.
        """
        return self.weights.sparkSession.createDataFrame(self.steps, TRACE_SCHEMA)


@dataclass(frozen=True)
class _Iterate:
    table: StoredTable
    history: PairHistory
    value: float


class _Training:
    def __init__(self, evaluation, examples, reg, num_corrections, num_blocks, joined):
        self.evaluation = evaluation
        self.num_features = examples.num_features
        self.reg = reg
        self.num_corrections = num_corrections
        self.spark: SparkSession = examples.df.sparkSession
        parts = int(self.spark.conf.get(PARTITIONS_SETTING))
        # Where the weights are sent, only sums per feature are shuffled.
        few = parts if joined else max(1, min(parts, examples.num_features // FEATURES_OF_A_BLOCK))
        self.num_blocks = num_blocks or few
        self.scratch = Scratch(self.spark)
        self.num_examples = 0

    def start(self, initial: DataFrame | None) -> _Iterate:
        weights = initial_weights(self.spark, self.num_features, initial)
        loss_row = self.spark.range(1).selectExpr(f"{LOSS_ROW} AS idx", "0D AS v")
        rows = weights.unionByName(loss_row).withColumnRenamed("v", "w")
        first = self.scratch.store_bucketed(rows, "weights", ["idx"], self.num_blocks)
        target = first.df.where(f"idx <> {LOSS_ROW}").selectExpr("idx", "w AS v")
        sums = self.scratch.store(self.evaluation.sums(target), "sums")
        counted = sums.df.where(F.col("idx") == LOSS_ROW).first()
        if counted is None:
            raise ValueError("no examples")
        self.num_examples = counted["cells"]
        empty = "cast(array() AS array<double>)"
        state = first.df.join(sums.df.hint("shuffle_hash"), "idx", "left").selectExpr(
            "idx", "w", f"{self._gradient()} AS g", f"{empty} AS s", f"{empty} AS t"
        )
        table, observed = self._stored(state, 0)
        self.scratch.discard(sums)
        self.scratch.discard(first)
        history = PairHistory.at_start(self.num_corrections, observed["g_0"])
        return _Iterate(table, history, self._value(observed))

    def step(self, at: _Iterate, coefficients: np.ndarray, length: float) -> _Iterate:
        """Evaluate at w + length * direction and store the state there."""
        kept = min(at.history.num_pairs, self.num_corrections - 1)
        table, observed = self._stored(self.next_state(at, coefficients, length), kept + 1)
        return _Iterate(table, at.history.extended(observed), self._value(observed))

    def next_state(self, at: _Iterate, coefficients: np.ndarray, length: float) -> DataFrame:
        move = combine(length * coefficients)
        state = at.table.df
        target = state.where(f"idx <> {LOSS_ROW}").selectExpr("idx", f"w + {move} AS v")
        sums = self.evaluation.sums(target)
        kept = min(at.history.num_pairs, self.num_corrections - 1)
        oldest = at.history.num_pairs - kept + 1
        new_s = f"if(idx = {LOSS_ROW}, 0D, {move})"
        moved = state.selectExpr(
            "idx", "w AS old_w", "g AS old_g", "s", "t", f"{new_s} AS new_s"
        ).selectExpr("*", "old_w + new_s AS w")
        return (
            moved.join(sums.hint("shuffle_hash"), "idx", "left")
            .selectExpr("*", f"{self._gradient()} AS g")
            .selectExpr(
                "idx",
                "w",
                "g",
                f"concat(slice(s, {oldest}, {kept}), array(new_s)) AS s",
                f"concat(slice(t, {oldest}, {kept}), array(g - old_g)) AS t",
            )
        )

    def _stored(self, state: DataFrame, pairs: int) -> tuple[StoredTable, dict[str, float]]:
        """The state as a table, and its newest products, from the tasks that write it."""
        newest = Observation()
        with self.settings():
            table = self.scratch.store_bucketed(
                state.observe(newest, *newest_products(pairs)), "state", ["idx"], self.num_blocks, aligned=True
            )
        return table, newest.get

    @contextmanager
    def settings(self) -> Iterator[None]:
        """For a plan of a known shape: as many partitions as the state has buckets, and no
        planning while it runs, which would make a job of every stage."""
        mine = {PARTITIONS_SETTING: str(self.num_blocks), "spark.sql.adaptive.enabled": "false"}
        before = {key: self.spark.conf.get(key) for key in mine}
        try:
            for key, value in mine.items():
                self.spark.conf.set(key, value)
            yield
        finally:
            for key, value in before.items():
                self.spark.conf.set(key, value)

    def search(self, at: _Iterate, coefficients: np.ndarray, slope: float):
        features = at.table.df.where(f"idx <> {LOSS_ROW}")
        return first_acceptable(
            self.evaluation,
            features.selectExpr("idx", "w AS v"),
            features.selectExpr("idx", f"{combine(coefficients)} AS v"),
            self.reg,
            at.value,
            slope,
        )

    def discard(self, iterate: _Iterate) -> None:
        self.scratch.discard(iterate.table)

    def _gradient(self) -> str:
        """Gradient from the sums; the loss row keeps its sum as it is."""
        total = "coalesce(total, 0D)"
        mean = f"{total} / {number(float(self.num_examples))} + {number(self.reg)} * w"
        return f"if(idx = {LOSS_ROW}, {total}, {mean})"

    def _value(self, observed: dict[str, float]) -> float:
        return observed["loss"] / self.num_examples + 0.5 * self.reg * observed["squares"]


def fit(
    examples: Examples,
    loss: Loss = LOGISTIC,
    reg: float = 0.01,
    num_iters: int = 20,
    num_corrections: int = 10,
    tol: float = 1e-10,
    initial: DataFrame | None = None,
    num_blocks: int | None = None,
    broadcast_features: int = BROADCAST_FEATURES,
    storage: StorageLevel | None = StorageLevel.MEMORY_AND_DISK,
    compute_last: bool = False,
) -> FittedModel:
    """Minimise mean loss + reg/2 * |w|^2 by L-BFGS.

    The result is the last iterate that is within the iteration limit and
    improved on its predecessor by ``tol``; the step that fails this test is
    discarded, so ``num_iters=K`` gives iterate K-1. Step K itself is only
    computed, for the trace, with ``compute_last``.

    ``num_blocks`` partitions the state tables by feature (default: by their number; the
    session's shuffle partitions where the weights are joined in). ``storage=None`` reads the examples from their source in
    each pass instead of caching them. Up to ``broadcast_features`` features the
    weights are sent whole to executors, beyond that they are joined in.
    """
    if num_iters < 1:
        raise ValueError("num_iters must be at least 1")
    if num_corrections < 1:
        raise ValueError("num_corrections must be at least 1")
    joined = examples.num_features > broadcast_features
    cached = storage is not None and not joined and not examples.df.is_cached
    examples = examples.validated()
    if cached:
        examples = examples.with_df(examples.df.persist(storage))
    scores = scores_for(examples, broadcast_features, storage=storage)
    try:
        training = _Training(
            Evaluation(scores, loss), examples, reg, num_corrections, num_blocks, joined
        )
        return _run(training, num_iters, tol, initial, compute_last)
    finally:
        scores.close()
        if cached:
            examples.df.unpersist()


def _run(training, num_iters, tol, initial, compute_last) -> FittedModel:
    at = training.start(initial)
    steps = [(0, at.value, None, None, 1, None, True)]
    number = 0
    while True:
        if number == num_iters - 1 and not compute_last:
            reason = "max_iterations"
            break
        history = at.history
        if number < WARM_STEPS:
            coefficients = history.steepest(WARM_SCALE)
        elif any(history.curvature(pair) == 0 for pair in range(history.num_pairs)):
            reason = "bad_curvature"
            break
        else:
            coefficients = history.quasi_newton()
        slope = history.slope(coefficients)
        if slope >= 0:
            reason = "not_descent"
            break

        length, trials = 1.0, 1
        after = training.step(at, coefficients, length)
        if not acceptable(after.value, at.value, length, slope):
            training.discard(after)
            found = training.search(at, coefficients, slope)
            if found is None:
                reason = "step_underflow"
                break
            position, length = found
            trials = position + 2
            after = training.step(at, coefficients, length)

        number += 1
        improvement = at.value - after.value
        curvature = after.history.curvature(after.history.num_pairs - 1)
        reason = _rejection(after.value, curvature, number, num_iters, improvement, tol)
        steps.append(
            (number, after.value, improvement, length, trials, curvature, reason is None)
        )
        log.info(
            "step %d: objective %.12g, improvement %.4g, step length %g",
            number, after.value, improvement, length,
        )
        if reason is not None:
            training.discard(after)
            break
        training.discard(at)
        at = after

    weights = at.table.df.where(F.col("idx") != LOSS_ROW).select("idx", F.col("w").alias("v"))
    return FittedModel(weights, at.value, reason, steps)


def _rejection(
    value: float, curvature: float, number: int, num_iters: int, improvement: float, tol: float
) -> str | None:
    """Why the step just taken is discarded, or None if it stands."""
    if math.isnan(value):
        return "nan_objective"
    if curvature < 0 or math.isnan(curvature):
        return "bad_curvature"
    if number >= num_iters:
        return "max_iterations"
    if not improvement >= tol:
        return "converged"
    return None
