import math

import pytest
from pyspark.sql import functions as F

from fitframe import LOGISTIC


def at(spark, y, z):
    df = spark.createDataFrame([(float(y), float(z))], "y double, z double")
    row = df.select(
        LOGISTIC.value(F.col("y"), F.col("z")), LOGISTIC.residual(F.col("y"), F.col("z"))
    ).first()
    return tuple(row)


@pytest.mark.parametrize("z", [-30.0, -2.0, 0.0, 0.5, 40.0])
@pytest.mark.parametrize("y", [0, 1])
def test_logistic(spark, y, z):
    p = 1 / (1 + math.exp(-z))
    loss = math.log1p(math.exp(-z)) + (0 if y else z)
    value, residual = at(spark, y, z)
    assert value == pytest.approx(loss, abs=1e-12)
    assert residual == pytest.approx(p - y, abs=1e-15)


@pytest.mark.parametrize(
    "y, z, loss, residual", [(1, -800, 800, -1), (0, -800, 0, 0), (1, 800, 0, 0), (0, 800, 800, 1)]
)
def test_logistic_stays_finite(spark, y, z, loss, residual):
    assert at(spark, y, z) == (loss, residual)
