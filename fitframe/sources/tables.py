"""Examples from DataFrames that are already loaded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fitframe.examples import Examples


def examples_from_columns(
    df: DataFrame, label: Column, features: Sequence[Column], id_col: str | None = None
) -> Examples:
    """Dense examples, one feature per given column."""
    values = F.array(*[f.cast("double") for f in features])
    kept = [id_col] if id_col else []
    return Examples(
        df.select(*kept, label.cast("double").alias("label"), values.alias("values")),
        len(features),
        id_col,
    ).validated()


def examples_from_array(
    df: DataFrame, label: Column, array: Column, num_features: int | None = None,
    id_col: str | None = None,
) -> Examples:
    """Dense examples from one array column.

    Without ``num_features`` one pass finds the longest array. Rows of another length fail
    the job that reads them.
    """
    kept = [id_col] if id_col else []
    rows = df.select(
        *kept,
        label.cast("double").alias("label"),
        array.cast("array<double>").alias("values"),
    )
    if num_features is None:
        num_features = rows.agg(F.max(F.size("values"))).first()[0]
        if num_features is None:
            raise ValueError("no examples")
    return Examples(rows, num_features, id_col).validated()


def examples_from_arrays(
    df: DataFrame, label: Column, indices: Column, values: Column, num_features: int,
    id_col: str | None = None,
) -> Examples:
    """Sparse examples from an index array and a value array."""
    kept = [id_col] if id_col else []
    rows = df.select(
        *kept,
        label.cast("double").alias("label"),
        indices.cast("array<int>").alias("indices"),
        values.cast("array<double>").alias("values"),
    )
    return Examples(rows, num_features, id_col).validated()
