"""The training-example table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from fitframe.functions.arrays import checked


@dataclass(frozen=True)
class Examples:
    """A DataFrame of labelled examples and its feature count.

    Sparse: ``label double, indices array<int>, values array<double>`` with
    0-based indices. Dense: ``label double, values array<double>``. Other
    columns are carried along; ``id_col`` names one that tells rows apart where there
    is one. Nothing here relies on ids being there or being unique.

    ``validated`` gives the same examples with a check in the scan itself: a row without
    a label, with a null cell, with another number of values than features, or with an
    index beyond them fails the job that reads it. Training and the objective only take
    such examples; plain scores let features beyond the weights count as 0.
    """

    df: DataFrame
    num_features: int
    id_col: str | None = None
    is_validated: bool = False

    @property
    def is_sparse(self) -> bool:
        return "indices" in self.df.columns

    def validated(self) -> "Examples":
        if self.is_validated:
            return self
        label = checked(F.col("label"), F.col("label").isNotNull(), "an example without a label")
        whole = F.size(F.array_compact("values")) == F.size("values")
        columns = {"label": label}
        if self.is_sparse:
            inside = (F.array_min("indices") >= 0) & (F.array_max("indices") < self.num_features)
            inside = (F.size("indices") == 0) | (inside & (F.size(F.array_compact("indices")) == F.size("indices")))
            fits = whole & inside & (F.size("indices") == F.size("values"))
            columns["indices"] = checked(
                F.col("indices"), fits, f"an example with a null, an index outside of 0 to {self.num_features - 1}, or uneven arrays"
            )
        else:
            fits = whole & (F.size("values") == self.num_features)
            columns["values"] = checked(
                F.col("values"), fits, f"an example whose values are not {self.num_features} numbers: ", F.size("values")
            )
        return replace(self, df=self.df.withColumns(columns), is_validated=True)

    def with_df(self, df: DataFrame) -> "Examples":
        return replace(self, df=df)

    def numbered_entries(self) -> DataFrame:
        """Long form ``(row_id, k, idx, v)``: the k-th stored cell of a row."""
        if self.id_col is None:
            raise ValueError("long form needs examples with an id_col")
        row_id = f"`{self.id_col}` AS row_id"
        if self.is_sparse:
            cells = self.df.selectExpr(row_id, "posexplode(arrays_zip(indices, values)) AS (k, cell)")
            return cells.selectExpr("row_id", "k", "cell.indices AS idx", "cell.values AS v")
        return self.df.selectExpr(row_id, "posexplode(values) AS (k, v)").selectExpr(
            "row_id", "k", "k AS idx", "v"
        )

    def entries(self) -> DataFrame:
        """Long form ``(row_id, idx, v)`` of the stored cells."""
        return self.numbered_entries().drop("k")
