"""Array expressions shared by the plans.

They are SQL text: one expression is then one call into the session, which
matters in a training loop that plans a few queries per step.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


PACKED_CHUNK = 1 << 15  # features collected and sorted by one task


def checked(value: Column, holds: Column, message: str, *about: Column) -> Column:
    """``value`` where ``holds``; elsewhere, null included, the job that reads it fails with the message."""
    text = F.concat(F.lit(message), *(F.coalesce(a.cast("string"), F.lit("null")) for a in about))
    return F.when(F.coalesce(holds, F.lit(False)), value).otherwise(F.raise_error(text))


def dense_dot(x: str, w: str) -> str:
    """Sum of x[i] * w[i]. A position that only one side has counts as 0."""
    terms = f"zip_with({x}, {w}, (a, b) -> coalesce(a * b, 0D))"
    return f"aggregate({terms}, 0D, (total, term) -> total + term)"


def short_dot(x: str, w: str, length: int) -> str:
    """``dense_dot`` written out, so that it compiles to plain arithmetic."""
    return " + ".join(f"coalesce(get({x}, {i}) * get({w}, {i}), 0D)" for i in range(length))


def sparse_dot(indices: str, values: str, w: str) -> str:
    """Sum of values[k] * w[indices[k]]. Indices outside ``w`` count as 0."""
    terms = f"zip_with({indices}, {values}, (i, v) -> v * coalesce(get({w}, i), 0D))"
    return f"aggregate({terms}, 0D, (total, term) -> total + term)"


def to_dense(indices: str, values: str, num_features: int) -> Column:
    """Sparse arrays to one array of ``num_features`` doubles; repeats add up.

    Indices outside the range are left out. One scatter per Arrow batch: array
    lambdas would search all stored cells for each of the features.
    """

    @F.arrow_udf("array<double>")
    def scatter(index_lists: pa.Array, value_lists: pa.Array) -> pa.Array:
        num_rows = len(index_lists)
        index = index_lists.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(num_rows), index_lists.value_lengths().to_numpy(zero_copy_only=False))
        value = value_lists.flatten().to_numpy(zero_copy_only=False)
        inside = (index >= 0) & (index < num_features)
        dense = np.bincount(
            row[inside] * num_features + index[inside],
            weights=value[inside],
            minlength=num_rows * num_features,
        )
        offsets = np.arange(num_rows + 1, dtype="int32") * num_features
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(dense))

    return scatter(F.col(indices), F.col(values))


def number(x: float) -> str:
    """A driver scalar as a double literal."""
    return f"{x!r}D" if math.isfinite(x) else f"double('{x}')"


def number_array(numbers: Iterable[float]) -> str:
    """Driver scalars as an array literal."""
    return f"array({', '.join(number(float(x)) for x in numbers)})"


def packed_vector(vector: DataFrame, num_features: int, value: str = "v") -> Column:
    """A whole ``(idx, value)`` vector as one array, for use as a scalar subquery.

    ``value`` may be any SQL expression over the vector's columns. The array
    holds ``num_features`` doubles, so callers check that number against their
    size bound first. The vector must have every index.
    """
    cells = vector.where(f"idx BETWEEN 0 AND {num_features - 1}")
    if num_features <= PACKED_CHUNK:
        return cells.agg(F.expr(_in_order("idx", value))).scalar()
    # Chunks are sorted in parallel; the last task only strings them together.
    chunks = cells.groupBy(F.expr(f"idx DIV {PACKED_CHUNK} AS chunk")).agg(
        F.expr(f"{_in_order('idx', value)} AS part")
    )
    return chunks.agg(F.expr(f"flatten({_in_order('chunk', 'part')})")).scalar()


def _in_order(key: str, value: str) -> str:
    return f"transform(sort_array(collect_list(struct({key} AS key, {value} AS v))), c -> c.v)"
