"""Two ways to give every example its linear scores.

``BroadcastScores`` sends the packed vector to the executors and needs no
shuffle; it serves vectors up to a size bound. ``JoinScores`` joins the vector
to the cells where that bound is passed, for feature spaces of any size.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from fitframe.examples import Examples
from fitframe.functions.arrays import dense_dot, packed_vector, short_dot, sparse_dot
from fitframe.plans.scratch import Scratch

# Longest vector sent whole to executors: one million doubles are 8 MB.
BROADCAST_FEATURES = 1_000_000

# Dense dot products up to this length are written out term by term. Measured:
# a third faster than the array lambdas at 4 to 32 terms, slower at 64.
SHORT_FEATURES = 32


class BroadcastScores:
    def __init__(self, examples: Examples):
        self.examples = examples

    def add(self, vectors: dict[str, DataFrame]) -> DataFrame:
        """The examples plus one score column per ``name: (idx, v)`` vector.

        Each vector must have a row for every feature.
        """
        df, width = self.examples.df, self.examples.num_features
        # A scalar subquery cannot stand inside a lambda, so it gets a column
        # first; the optimizer folds it into the score and no row carries it.
        packed = [packed_vector(v, width).alias(f"_{name}") for name, v in vectors.items()]
        scores = [f"{self._dot(f'_{name}')} AS {name}" for name in vectors]
        return df.select("*", *packed).selectExpr(*df.columns, *scores)

    def _dot(self, packed: str) -> str:
        if self.examples.is_sparse:
            return sparse_dot("indices", "values", packed)
        if self.examples.num_features <= SHORT_FEATURES:
            return short_dot("values", packed, self.examples.num_features)
        return dense_dot("values", packed)

    def close(self) -> None:
        """Nothing is held beyond the examples."""


class JoinScores:
    """For feature spaces of any size: frequent features sent, the others joined.

    Most cells usually belong to few features. The most frequent ones, up to the
    same size bound, are packed like a short vector and need no shuffle; only
    cells of the remaining features are joined with the weights, and only their
    partial scores are shuffled. Every feature with more cells than an even
    partition's share is among the frequent ones (see ``frequent_features``), so
    the join has no hot keys.

    With a storage level both layouts are cached and stay where they are from
    one evaluation to the next.
    """

    def __init__(
        self,
        examples: Examples,
        broadcast_features: int = BROADCAST_FEATURES,
        num_partitions: int | None = None,
        storage: StorageLevel | None = None,
    ):
        spark = examples.df.sparkSession
        parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._scratch = Scratch(spark)
        self._tables = []
        self._columns = examples.df.columns
        # Rows get numbers of their own, as ids may be missing or repeat. They must be
        # the same in both layouts: stored once.
        id_col = "_row_id"
        while id_col in self._columns:
            id_col = f"_{id_col}"
        numbered = examples.df.withColumn(id_col, F.monotonically_increasing_id())
        examples = Examples(self._store(numbered, "examples"), examples.num_features, id_col)

        counts = examples.entries().groupBy("idx").agg(F.expr("count(1) AS n"))
        counts = self._store(counts, "feature-counts")
        frequent = frequent_features(counts, max(broadcast_features, 2 * parts))
        self._frequent = self._store(frequent, "frequent-features")
        self._num_frequent = self._frequent.count()

        # The size bound of the frequent features makes this broadcast safe.
        cells = examples.numbered_entries().join(F.broadcast(self._frequent), "idx", "left")
        rare = cells.where("place IS NULL").select("row_id", "idx", "v")
        places = cells.groupBy(F.col("row_id").alias(id_col)).agg(
            F.expr(
                """transform(sort_array(collect_list(struct(k, coalesce(place, -1) AS place))),
                             c -> c.place) AS _places"""
            )
        )
        rows = examples.df.join(places, id_col, "left")
        # Sorted, so that no join with the cached layouts sorts them again.
        rows = rows.repartition(parts, id_col).sortWithinPartitions(id_col)
        rare = rare.repartition(parts, "idx").sortWithinPartitions("idx")
        self._held = [rows, rare] if storage is not None else []
        for layout in self._held:
            layout.persist(storage)
        self._rare = rare
        self.examples = examples.with_df(rows)

    def add(self, vectors: dict[str, DataFrame]) -> DataFrame:
        """As ``BroadcastScores.add``; features missing from a vector count as 0."""
        rows, id_col = self.examples.df, self.examples.id_col
        lookup, packed = None, []
        for name, vector in vectors.items():
            column = vector.selectExpr("idx", f"v AS _{name}")
            lookup = column if lookup is None else lookup.join(column, "idx", "full")
            placed = self._frequent.join(vector, "idx", "left").selectExpr(
                "place AS idx", "coalesce(v, 0D) AS v"
            )
            packed.append(packed_vector(placed, self._num_frequent).alias(f"_packed_{name}"))
        partial = (
            self._rare.join(lookup, "idx")
            .groupBy(F.col("row_id").alias(id_col))
            .agg(*[F.expr(f"sum(v * _{name}) AS _rare_{name}") for name in vectors])
        )
        # Examples without rare features have no partial score, those without
        # any cell no places: their share is 0.
        scores = [
            f"""coalesce({sparse_dot("_places", "values", f"_packed_{name}")}, 0D)
                + coalesce(_rare_{name}, 0D) AS {name}"""
            for name in vectors
        ]
        return (
            rows.join(partial, id_col, "left")
            .select("*", *packed)
            .selectExpr(*self._columns, *scores)
        )

    def _store(self, df: DataFrame, name: str) -> DataFrame:
        table = self._scratch.store(df, name)
        self._tables.append(table)
        return table.df

    def close(self) -> None:
        """Drop caches and stored tables; results of ``add`` end with them."""
        for held in self._held:
            held.unpersist()
        for table in self._tables:
            self._scratch.discard(table)


def frequent_features(counts: DataFrame, limit: int) -> DataFrame:
    """``(idx, place)`` for at most ``limit`` features, the most frequent ones.

    ``counts`` is ``(idx, n)``. The cut is at a power of two, so it needs only
    the number of features per count length in bits. With a limit of twice the
    partitions, no feature above an even partition's share s of the cells is
    missed: less than 2 * partitions features can have s / 2 cells or more.
    """
    bits = "char_length(bin(n))"
    sizes = counts.groupBy(F.expr(f"{bits} AS bits")).agg(F.expr("count(1) AS features"))
    taken, cut = 0, 65
    for row in sorted(sizes.collect(), key=lambda r: -r["bits"]):  # 64 rows at most
        taken += row["features"]
        if taken > limit:
            break
        cut = row["bits"]
    # The window holds no more than ``limit`` rows.
    return counts.where(f"{bits} >= {cut}").selectExpr(
        "idx", "cast(row_number() OVER (ORDER BY idx) - 1 AS int) AS place"
    )


def scores_for(
    examples: Examples,
    broadcast_features: int = BROADCAST_FEATURES,
    num_partitions: int | None = None,
    storage: StorageLevel | None = None,
) -> BroadcastScores | JoinScores:
    """Broadcast up to ``broadcast_features``, join beyond."""
    if examples.num_features <= broadcast_features:
        return BroadcastScores(examples)
    return JoinScores(examples, broadcast_features, num_partitions, storage)
