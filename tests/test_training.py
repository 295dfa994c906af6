import numpy as np
import pytest
from pyspark.sql import functions as F

from fitframe import (
    Examples,
    Loss,
    examples_from_array,
    examples_from_arrays,
    fit,
    linear_scores,
    score,
    train_and_rate,
)
from fitframe.operators.objective import evaluate, gradient, objective
from fitframe.plans.linesearch import STEPS

from checks import tables
from numpy_method import auc, loss_and_gradient, optimum, train


def dense(spark, x, y):
    data = [(i, float(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "id long, y double, x array<double>").repartition(4)
    return examples_from_array(df, F.col("y"), F.col("x"), x.shape[1], id_col="id")


def sparse(spark, x, y):
    data = [
        (i, float(b), [int(j) for j in np.nonzero(a)[0]], [float(v) for v in a[a != 0]])
        for i, (a, b) in enumerate(zip(x, y))
    ]
    df = spark.createDataFrame(data, "id long, y double, i array<int>, v array<double>").repartition(4)
    return examples_from_arrays(df, F.col("y"), F.col("i"), F.col("v"), x.shape[1], id_col="id")


def vector(spark, x):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "idx int, v double")


def values(df):
    return np.array([r["v"] for r in df.orderBy("idx").collect()])


def objectives(model):
    return [r["objective"] for r in model.trace.orderBy("iter").collect()]


@pytest.fixture(scope="module")
def data():
    """Skewed on purpose: one feature in every row, empty rows, an unused feature."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 40)) * (rng.uniform(size=(300, 40)) < 0.1)
    x[:, 0] = 1.0
    x[:20] = 0.0
    x[:, 39] = 0.0
    x[20:220, 38] = 0.5
    y = (rng.uniform(size=300) < 1 / (1 + np.exp(-x @ rng.normal(size=40)))).astype(float)
    return x, y


LAYOUTS = ["dense", "sparse", "joined", "joined without id", "joined dense"]


def laid_out(spark, data, layout):
    x, y = data
    examples = dense(spark, x, y) if "dense" in layout else sparse(spark, x, y)
    if "without" in layout:
        examples = Examples(examples.df.drop("id"), examples.num_features)
    return examples, {"broadcast_features": 0} if "joined" in layout else {}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_evaluation(spark, data, layout):
    examples, options = laid_out(spark, data, layout)
    w = np.linspace(-1, 1, 40)
    f, g = loss_and_gradient(*data, w, 0.1)
    found = values(evaluate(examples, vector(spark, w), reg=0.1, **options))
    np.testing.assert_allclose(found, [f, *g], rtol=1e-12, atol=1e-14)


def test_objective_without_gradient(spark, data):
    w = np.linspace(-1, 1, 40)
    row = objective(dense(spark, *data), vector(spark, w), reg=0.1).first()
    assert row["objective"] == pytest.approx(loss_and_gradient(*data, w, 0.1)[0])


def test_gradient_is_the_slope_of_the_objective(spark, data):
    examples, w, h = sparse(spark, *data), np.linspace(-1, 1, 40), 1e-5
    g = values(gradient(examples, vector(spark, w), reg=0.1))
    for i in (0, 7, 39):
        e = np.eye(40)[i] * h
        up, down = (objective(examples, vector(spark, v), reg=0.1).first()["objective"] for v in (w + e, w - e))
        assert (up - down) / (2 * h) == pytest.approx(g[i], abs=1e-8)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_training_follows_the_method(spark, data, layout):
    examples, options = laid_out(spark, data, layout)
    model = fit(examples, reg=0.01, num_iters=9, num_corrections=3, **options)
    expected, lengths, w = train(*data, reg=0.01, num_iters=9, corrections=3)
    np.testing.assert_allclose(objectives(model), expected, rtol=1e-9)
    np.testing.assert_allclose(values(model.weights), w, rtol=1e-6, atol=1e-9)
    assert model.stop_reason == "max_iterations" and model.num_steps == 8


@pytest.mark.parametrize("corrections", [1, 2])
def test_short_histories(spark, data, corrections):
    model = fit(dense(spark, *data), reg=0.01, num_iters=8, num_corrections=corrections, num_blocks=3)
    expected, _, w = train(*data, reg=0.01, num_iters=8, corrections=corrections)
    np.testing.assert_allclose(objectives(model), expected, rtol=1e-9)
    np.testing.assert_allclose(values(model.weights), w, rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("layout", ["dense", "joined"])
def test_backtracking(spark, data, layout):
    x, y = data
    examples, options = laid_out(spark, (30 * x, y), layout)
    model = fit(examples, reg=0.01, num_iters=6, **options)
    expected, lengths, _ = train(30 * x, y, reg=0.01, num_iters=6, corrections=10)
    np.testing.assert_allclose(objectives(model), expected, rtol=1e-9)
    trace = model.trace.orderBy("iter").collect()[1:]
    assert [r["step"] for r in trace] == lengths and min(lengths) < 0.1
    assert [2.0 ** (1 - r["trials"]) for r in trace] == lengths


def test_known_traces(spark, small):
    examples = tables.embedding_examples(spark, small)
    model = fit(examples)
    np.testing.assert_allclose(
        objectives(model)[:5],
        [0.6931471806, 0.6928794653, 0.6926155570, 0.6923554012, 0.6741580987],
        atol=1e-8,
    )
    assert model.objective == pytest.approx(0.674156157, abs=1e-8)
    assert model.stop_reason == "converged"


def test_converges_to_the_optimum(spark, data):
    model = fit(dense(spark, *data), reg=0.05, num_iters=60, tol=1e-15)
    np.testing.assert_allclose(values(model.weights), optimum(*data, 0.05), atol=1e-5)
    assert model.stop_reason in ("converged", "step_underflow", "not_descent")
    improvements = [r["improvement"] for r in model.trace.where("iter > 0 AND accepted").collect()]
    assert min(improvements) > 0


def test_iteration_limit_keeps_the_previous_iterate(spark, data):
    examples = dense(spark, *data)
    assert not values(fit(examples, num_iters=1).weights).any()
    with pytest.raises(ValueError):
        fit(examples, num_iters=0)
    with pytest.raises(ValueError):
        fit(examples, num_corrections=0)
    seen = fit(examples, num_iters=2, compute_last=True)
    assert [r["accepted"] for r in seen.trace.orderBy("iter").collect()] == [True, True, False]
    np.testing.assert_array_equal(values(seen.weights), values(fit(examples, num_iters=2).weights))


def test_a_step_below_the_tolerance_is_discarded(spark, data):
    model = fit(dense(spark, *data), tol=1.0)
    assert model.stop_reason == "converged" and model.num_steps == 0
    assert not values(model.weights).any()


def test_warm_start_at_the_optimum_stops(spark, data):
    w = optimum(*data, 0.5)
    model = fit(dense(spark, *data), reg=0.5, initial=vector(spark, w))
    np.testing.assert_allclose(values(model.weights), w, atol=1e-12)
    assert model.stop_reason in ("converged", "not_descent", "step_underflow")


def test_zero_gradient_is_not_a_descent(spark):
    model = fit(dense(spark, np.array([[1.0], [1.0]]), np.array([0.0, 1.0])))
    assert model.stop_reason == "not_descent" and model.num_steps == 0


def test_no_examples(spark):
    empty = dense(spark, np.ones((1, 2)), np.ones(1))
    with pytest.raises(ValueError, match="no examples"):
        fit(empty.with_df(empty.df.where("label > 5")))


def test_any_loss_can_be_plugged_in(spark, data):
    x, y = data
    squares = Loss(value=lambda y, z: (z - y) * (z - y), residual=lambda y, z: 2 * (z - y))
    model = fit(dense(spark, x, y), loss=squares, reg=0.2, num_iters=60, tol=1e-15)
    exact = np.linalg.solve(2 * x.T @ x / len(y) + 0.2 * np.eye(40), 2 * x.T @ y / len(y))
    np.testing.assert_allclose(values(model.weights), exact, atol=1e-5)


def test_linear_loss_ends_with_bad_curvature(spark):
    """Without curvature the pairs are useless: training stops after the warm steps."""
    line = Loss(value=lambda y, z: z + 0 * y, residual=lambda y, z: F.lit(1.0))
    model = fit(dense(spark, np.ones((4, 1)), np.ones(4)), loss=line, reg=0.0)
    assert model.stop_reason == "bad_curvature" and model.num_steps == 3
    assert values(model.weights) == [-1.5]


def test_negative_curvature_discards_the_step(spark):
    cap = Loss(value=lambda y, z: -z * z - z, residual=lambda y, z: -2 * z - 1)
    model = fit(dense(spark, np.ones((4, 1)), np.ones(4)), loss=cap, reg=0.0)
    assert model.stop_reason == "bad_curvature" and model.num_steps == 0
    assert values(model.weights) == [0.0]


def test_nan_objective_discards_the_step(spark):
    broken = Loss(
        value=lambda y, z: F.when(z == 0, F.lit(0.0)).otherwise(F.lit(float("nan"))),
        residual=lambda y, z: F.lit(1.0),
    )
    model = fit(dense(spark, np.ones((4, 1)), np.ones(4)), loss=broken)
    assert model.stop_reason == "nan_objective" and values(model.weights) == [0.0]


def test_step_underflow(spark):
    """A direction along which the reported loss only grows."""
    liar = Loss(value=lambda y, z: F.abs(z), residual=lambda y, z: F.lit(1.0))
    model = fit(dense(spark, np.ones((4, 1)), np.ones(4)), loss=liar, reg=0.0)
    assert model.stop_reason == "step_underflow" and values(model.weights) == [0.0]
    assert len(STEPS) == 68 and STEPS[-1] == 2.0**-67


def test_scores(spark, data):
    x, y = data
    w = np.linspace(-1, 1, 40)
    expected = 1 / (1 + np.exp(-x @ w))
    for layout in LAYOUTS:
        examples, options = laid_out(spark, data, layout)
        scored = score(examples, vector(spark, w), threshold=0.5, **options)
        if "without" not in layout:
            rows = scored.orderBy("id").collect()
            np.testing.assert_allclose([r["score"] for r in rows], expected, rtol=1e-12)
            assert [r["prediction"] for r in rows] == list((expected > 0.5).astype(float))
        assert scored.count() == 300


def test_features_beyond_the_weights_count_as_zero(spark):
    examples = sparse(spark, np.array([[1.0, 2.0, 4.0]]), np.ones(1))
    narrow = Examples(examples.df, 2, "id")
    assert linear_scores(narrow, vector(spark, [1.0, 1.0])).first()["z"] == 3.0
    assert linear_scores(narrow, vector(spark, [1.0, 1.0]), broadcast_features=0).first()["z"] == 3.0


def test_train_and_rate(spark, data):
    x, y = data
    examples = dense(spark, x, y)
    result = train_and_rate(examples, examples, reg=0.01, num_iters=10)
    expected = auc(x @ values(result.model.weights), y)
    assert result.auc == pytest.approx(expected, abs=1e-3) and result.auc > 0.7
    assert result.scored.count() == 300


def test_nothing_stays_cached(spark, data):
    spark.catalog.clearCache()
    for layout in ("dense", "joined"):
        examples, options = laid_out(spark, data, layout)
        fit(examples, num_iters=2, **options)
    persistent = spark.sparkContext._jsc.getPersistentRDDs()
    assert persistent.isEmpty()


def test_without_a_cache(spark, data):
    model = fit(dense(spark, *data), num_iters=3, storage=None)
    assert objectives(model) == pytest.approx(train(*data, reg=0.01, num_iters=3, corrections=10)[0])


def step_plan(spark, examples, **options):
    """The physical plan of a step, as the training loop runs it."""
    from fitframe.plans import fit as module

    plans = []
    real = module._Training.next_state

    def seen(self, at, coefficients, length):
        state = real(self, at, coefficients, length)
        with self.settings():
            plans.append(state._jdf.queryExecution().executedPlan().toString())
        return state

    module._Training.next_state = seen
    try:
        fit(examples, num_iters=5, **options)
    finally:
        module._Training.next_state = real
    return plans[-1]


def test_a_step_shuffles_sums_and_not_the_state(spark, data):
    lines = step_plan(spark, dense(spark, *data), num_blocks=3).split("\n")
    # Neither the vector's subquery nor what lies below the cached examples.
    end = next(i for i, line in enumerate(lines) if "InMemoryRelation" in line)
    main, inner = [], None
    for line in lines[:end]:
        depth = len(line) - len(line.lstrip(" :+-*"))
        if inner is not None and depth > inner:
            continue
        inner = depth if "Subquery" in line and "scalar-subquery" in line and "Project" not in line else None
        if inner is None:
            main.append(line)
    joined = next(i for i, line in enumerate(main) if "ShuffledHashJoin" in line)
    state = next(i for i, line in enumerate(main) if "Scan parquet spark_catalog.fitframe" in line)
    shuffled = [i for i, line in enumerate(main) if "Exchange" in line]
    # The stored state comes under the join as it is; the one shuffle is that of the sums.
    assert joined < state and len(shuffled) == 1 and state < shuffled[0]
    assert "SelectedBucketsCount: 3 out of 3" in main[state]


def test_a_step_is_few_jobs(spark, data):
    examples = dense(spark, *data)
    group = "steps-of-training"
    tracker = spark.sparkContext.statusTracker()
    counts = []
    for iters in (4, 9):
        spark.sparkContext.setJobGroup(f"{group}-{iters}", "")
        model = fit(examples, num_iters=iters, tol=0)
        assert model.num_steps == iters - 1
        counts.append(len(tracker.getJobIdsForGroup(f"{group}-{iters}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] - counts[0] <= 5 * 3
