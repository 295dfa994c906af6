"""Vectors over the feature space as ``(idx int, v double)`` tables.

A missing index counts as 0. Scalars come back as one-row DataFrames, so that
they can feed further plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fitframe.functions.arrays import checked


def completed(vector: DataFrame, num_features: int) -> DataFrame:
    """The vector with a row for each of the indices 0 .. num_features - 1.

    An index outside of them, or none, fails the job.
    """
    inside = F.col("given").between(0, num_features - 1)
    given = vector.select(F.col("idx").cast("int").alias("given"), "v")
    given = given.select(checked(F.col("given"), inside, f"an index outside of 0 to {num_features - 1}: ", F.col("given")).alias("idx"), "v")
    indices = vector.sparkSession.range(num_features).select(F.col("id").cast("int").alias("idx"))
    return indices.join(given, "idx", "left").select(
        "idx", F.coalesce(F.col("v"), F.lit(0.0)).alias("v")
    )


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row ``(dot)``: the sum of x[i] * y[i]."""
    pairs = x.join(y.withColumnRenamed("v", "w"), "idx")
    return pairs.agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("dot"))


def axpy(a: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """y + a * x."""
    pairs = x.join(y.withColumnRenamed("v", "w"), "idx", "full")
    moved = F.coalesce(F.col("w"), F.lit(0.0)) + F.lit(float(a)) * F.coalesce(F.col("v"), F.lit(0.0))
    return pairs.select("idx", moved.alias("v"))


def scal(a: float, x: DataFrame) -> DataFrame:
    return x.select("idx", (F.lit(float(a)) * F.col("v")).alias("v"))


def norm2(x: DataFrame) -> DataFrame:
    """One row ``(norm)``: the Euclidean length."""
    squares = F.sum(F.col("v") * F.col("v"))
    return x.agg(F.sqrt(F.coalesce(squares, F.lit(0.0))).alias("norm"))


def plus(x: DataFrame, y: DataFrame) -> DataFrame:
    return axpy(1.0, x, y)


def minus(x: DataFrame, y: DataFrame) -> DataFrame:
    """x - y."""
    return axpy(-1.0, y, x)
