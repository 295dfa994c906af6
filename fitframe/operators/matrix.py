"""Matrices distributed by row: one table row per feature.

A matrix is ``(idx int, row array<double>)`` with known sizes, so that adding,
dropping or combining columns is a projection or one join on ``idx``, and no
operator needs a job to learn a width. Indices are unique, so the joins have
no hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fitframe.functions.arrays import checked, dense_dot, number_array, packed_vector


@dataclass(frozen=True)
class DistributedMatrix:
    rows: DataFrame
    num_rows: int
    num_cols: int

    @staticmethod
    def from_rows(
        rows: DataFrame, num_rows: int | None = None, num_cols: int | None = None
    ) -> "DistributedMatrix":
        """From ``(idx, row)``. Sizes that are not given cost one job."""
        if num_rows is None or num_cols is None:
            counted = rows.agg(
                F.count(F.lit(1)).alias("n"), F.max(F.size("row")).alias("width")
            ).first()
            num_rows = counted["n"] if num_rows is None else num_rows
            num_cols = (counted["width"] or 0) if num_cols is None else num_cols
        return DistributedMatrix(rows.select("idx", "row"), num_rows, num_cols)

    @staticmethod
    def from_cells(cells: DataFrame, num_rows: int, num_cols: int) -> "DistributedMatrix":
        """From ``(idx, col, v)``. Missing cells are 0, repeated ones add up.

        A cell outside the sizes fails the job.
        """
        inside = F.col("idx").between(0, num_rows - 1) & F.col("col").between(0, num_cols - 1)
        place = F.concat_ws(", ", F.col("idx").cast("string"), F.col("col").cast("string"))
        cells = cells.select(
            checked(F.col("idx"), inside, f"a cell outside of {num_rows} x {num_cols}: ", place).alias("idx"), "col", "v"
        )
        unique = cells.groupBy("idx", "col").agg(F.sum("v").alias("v"))
        # At most num_cols cells per idx are left to collect here.
        stored = unique.groupBy("idx").agg(
            F.map_from_entries(F.collect_list(F.struct("col", "v"))).alias("cells")
        )
        indices = cells.sparkSession.range(num_rows).select(F.col("id").cast("int").alias("idx"))
        row = F.transform(
            F.sequence(F.lit(0), F.lit(num_cols - 1)),
            lambda c: F.coalesce(F.col("cells")[c], F.lit(0.0)),
        )
        return DistributedMatrix(
            indices.join(stored, "idx", "left").select("idx", row.alias("row")),
            num_rows,
            num_cols,
        )

    def append_column(self, vector: DataFrame) -> "DistributedMatrix":
        """Add a ``(idx, v)`` vector as the last column. Both need the same indices."""
        wider = self._with(vector.select("idx", F.array("v").alias("right")), "vector")
        return DistributedMatrix(wider, self.num_rows, self.num_cols + 1)

    def drop_first_column(self) -> "DistributedMatrix":
        if self.num_cols == 0:
            raise ValueError("the matrix has no column to drop")
        rest = F.slice("row", 2, self.num_cols - 1)
        return DistributedMatrix(
            self.rows.select("idx", rest.alias("row")), self.num_rows, self.num_cols - 1
        )

    def concat(self, other: "DistributedMatrix") -> "DistributedMatrix":
        """The columns of this matrix, then those of ``other``."""
        if self.num_rows != other.num_rows:
            raise ValueError(f"{self.num_rows} rows against {other.num_rows}")
        joined = self._with(other.rows.withColumnRenamed("row", "right"), "other matrix")
        return DistributedMatrix(joined, self.num_rows, self.num_cols + other.num_cols)

    def _with(self, right: DataFrame, what: str) -> DataFrame:
        """Rows extended by ``(idx, right)``; an index that only one side has fails the job."""
        joined = self.rows.join(right, "idx", "full")
        left = checked(F.col("row"), F.col("row").isNotNull(), "the matrix has no row ", F.col("idx"))
        added = checked(F.col("right"), F.col("right").isNotNull(), f"the {what} has no row ", F.col("idx"))
        return joined.select("idx", F.concat(left, added).alias("row"))

    def column(self, i: int) -> DataFrame:
        """Column ``i`` as a ``(idx, v)`` vector."""
        if not 0 <= i < self.num_cols:
            raise ValueError(f"column {i} of {self.num_cols}")
        return self.rows.select("idx", F.get("row", F.lit(i)).alias("v"))

    def last_column(self) -> DataFrame:
        return self.column(self.num_cols - 1)

    def left_multiply(self, vector: DataFrame) -> DataFrame:
        """Vector times matrix: ``(col, v)`` with one row per column."""
        weighted = self.rows.join(vector, "idx").select("v", F.posexplode("row").alias("col", "cell"))
        return weighted.groupBy("col").agg(F.sum(F.col("v") * F.col("cell")).alias("v"))

    def right_multiply(self, coefficients: Sequence[float] | DataFrame) -> DataFrame:
        """Matrix times a vector of column weights: ``(idx, v)``.

        The weights are a sequence, or ``(col, v)`` with a row per column.
        """
        if isinstance(coefficients, DataFrame):
            by_col = coefficients.withColumnRenamed("col", "idx")
            weights = packed_vector(by_col, self.num_cols)
        else:
            if len(coefficients) != self.num_cols:
                raise ValueError(f"{len(coefficients)} weights for {self.num_cols} columns")
            weights = F.expr(number_array(coefficients))
        attached = self.rows.select("idx", "row", weights.alias("weights"))
        return attached.selectExpr("idx", f"{dense_dot('row', 'weights')} AS v")

    def gram(self) -> DataFrame:
        """All inner products of columns, ``(i, j, v)`` for i <= j.

        Every partition multiplies its own block and sends one number per pair
        of columns; no pairs of cells are ever formed as rows.
        """
        width = self.num_cols

        def block_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, width))
            for batch in batches:
                lengths = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
                if not (lengths == width).all():
                    raise ValueError(f"a row that does not have {width} numbers")
                block = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                block = block.reshape(-1, width)
                total += block.T @ block
            i, j = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype("int32")), pa.array(j.astype("int32")), pa.array(total[i, j])],
                names=["i", "j", "v"],
            )

        parts = self.rows.select("row").mapInArrow(block_products, "i int, j int, v double")
        return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))

    def to_vector(self) -> DataFrame:
        """The only column as a vector in index order."""
        if self.num_cols != 1:
            raise ValueError(f"a vector has one column, not {self.num_cols}")
        return self.column(0).orderBy("idx")

    def to_dense(self) -> DataFrame:
        """``(idx, row)`` in index order."""
        return self.rows.orderBy("idx")

    def cells(self) -> DataFrame:
        """Long form ``(idx, col, v)``."""
        return self.rows.select("idx", F.posexplode("row").alias("col", "v"))
