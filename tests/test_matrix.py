import numpy as np
import pytest

from fitframe import DistributedMatrix
from fitframe.operators import vectors
from fitframe.operators.direction import descent_direction

from numpy_method import vector_two_loop

P = 23


def frame(spark, x):
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(data, "idx int, row array<double>").repartition(5)


def vector(spark, x):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "idx int, v double")


def matrix(spark, x):
    return DistributedMatrix.from_rows(frame(spark, x))


def dense(m):
    return np.array([r["row"] for r in m.to_dense().collect()])


def values(df, key="idx"):
    return np.array([r["v"] for r in df.orderBy(key).collect()])


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(3).normal(size=(P, 4))


def test_sizes_and_columns(spark, x):
    m = matrix(spark, x)
    assert (m.num_rows, m.num_cols) == (P, 4)
    np.testing.assert_array_equal(values(m.column(2)), x[:, 2])
    np.testing.assert_array_equal(values(m.last_column()), x[:, 3])
    with pytest.raises(ValueError):
        m.column(4)


def test_append_drop_concat(spark, x):
    m = matrix(spark, x)
    v = np.arange(P)
    np.testing.assert_array_equal(dense(m.append_column(vector(spark, v))), np.c_[x, v])
    np.testing.assert_array_equal(dense(m.drop_first_column()), x[:, 1:])
    np.testing.assert_array_equal(dense(m.concat(m.drop_first_column())), np.c_[x, x[:, 1:]])
    empty = m.drop_first_column().drop_first_column().drop_first_column().drop_first_column()
    assert empty.num_cols == 0
    np.testing.assert_array_equal(dense(empty.append_column(vector(spark, v)))[:, 0], v)
    with pytest.raises(ValueError):
        empty.drop_first_column()
    with pytest.raises(ValueError):
        m.concat(matrix(spark, x[:5]))


def test_products(spark, x):
    m, v, c = matrix(spark, x), np.arange(P) / 3, np.array([1.0, -2.0, 0.0, 0.5])
    np.testing.assert_allclose(values(m.left_multiply(vector(spark, v)), "col"), v @ x)
    np.testing.assert_allclose(values(m.right_multiply(c)), x @ c)
    weights = spark.createDataFrame([(i, float(v)) for i, v in enumerate(c)], "col int, v double")
    np.testing.assert_allclose(values(m.right_multiply(weights)), x @ c)
    with pytest.raises(ValueError):
        m.right_multiply([1.0])
    gram = np.zeros((4, 4))
    for row in m.gram().collect():
        gram[row["i"], row["j"]] = gram[row["j"], row["i"]] = row["v"]
    np.testing.assert_allclose(gram, x.T @ x)


def test_from_cells_fills_and_adds(spark):
    cells = spark.createDataFrame(
        [(0, 1, 2.0), (0, 1, 3.0), (2, 0, 1.0)], "idx int, col int, v double"
    )
    m = DistributedMatrix.from_cells(cells, 3, 2)
    np.testing.assert_array_equal(dense(m), [[0, 5], [0, 0], [1, 0]])
    with pytest.raises(ValueError):
        m.to_vector()
    one = DistributedMatrix.from_cells(cells.where("col = 1"), 3, 2).drop_first_column()
    assert [r["v"] for r in one.to_vector().collect()] == [5, 0, 0]


@pytest.mark.parametrize("pairs", [1, 3, 5])
def test_direction_equals_recursion_on_vectors(spark, pairs):
    rng = np.random.default_rng(pairs)
    s = rng.normal(size=(P, pairs))
    t = s * rng.uniform(0.5, 2.0, size=(P, 1))  # positive curvature
    g = rng.normal(size=P)
    d = descent_direction(matrix(spark, s), matrix(spark, t), vector(spark, g))
    expected = vector_two_loop([(s[:, k], t[:, k]) for k in range(pairs)], g)
    np.testing.assert_allclose(values(d), expected, rtol=1e-9)


def test_direction_needs_curvature(spark, x):
    g = vector(spark, np.ones(P))
    with pytest.raises(ValueError):
        descent_direction(matrix(spark, x), matrix(spark, -x), g)


def test_vectors(spark):
    a, b = vector(spark, [1, 2, 3]), vector(spark, [4, 0, -1])
    assert vectors.dot(a, b).first()["dot"] == 1
    assert vectors.norm2(b).first()["norm"] == pytest.approx(17**0.5)
    assert list(values(vectors.axpy(2, a, b))) == [6, 4, 5]
    assert list(values(vectors.scal(-1, a))) == [-1, -2, -3]
    assert list(values(vectors.plus(a, b))) == [5, 2, 2]
    assert list(values(vectors.minus(a, b))) == [-3, 2, 4]
    assert list(values(vectors.completed(a.where("idx <> 1"), 5))) == [1, 0, 3, 0, 0]
    sparse = vectors.axpy(1, a.where("idx = 0"), b.where("idx = 2"))
    assert list(values(sparse)) == [1, -1]


def test_long_vectors_are_packed_in_order(spark, monkeypatch):
    from fitframe.functions import arrays

    monkeypatch.setattr(arrays, "PACKED_CHUNK", 10)
    shuffled = vector(spark, np.arange(95) * 0.5).repartition(7)
    packed = arrays.packed_vector(shuffled, 95)
    row = spark.range(1).select(packed.alias("x")).first()
    assert row["x"] == [0.5 * i for i in range(95)]
