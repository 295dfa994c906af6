"""Searches of some vectors among all, block against block.

Queries and candidates are dealt into groups by hash. A pair of a query group and a
candidate group is one unit of work, whose two sides meet in one call. Group sizes
are bounded, and follow from the number of vectors alone, not from any setting.

The candidate groups come in waves, each ``WAVE`` times as many as all before. Every
query carries the score of its k-th best candidate so far into the next wave, and a
unit only returns what reaches it. So a query gets back about ``WAVE`` times k rows a
wave, however many groups there are, and nothing that belongs to the result is lost.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fitframe.plans.scratch import Scratch

LARGEST_GROUP, SMALLEST_GROUP = 1 << 15, 1 << 9
#: Groups of candidates that a small table is dealt into, as far as that leaves no group below the least.
GROUPS = 64
WAVE = 16

# (query columns, candidate columns, floor per query) -> query ids, candidate ids, scores
Search = Callable[[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable_vectors(vectors: DataFrame, key: str, vector: str, zeros: bool) -> DataFrame:
    """``id, v, width`` of vectors without null and non-finite components; one row per id, the least."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zeros:
        good = good & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(key).isNotNull() & F.coalesce(good, F.lit(False)) & (F.size(vector) > 0))
    picked = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    return picked.groupBy("id").agg(F.min("v").alias("v")).withColumn("width", F.size("v"))


def whole_below(x: Column) -> Column:
    """The floor of a double as a double, also where a long cannot hold it."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def matrix(lists: pa.ChunkedArray, rows: int) -> np.ndarray:
    """Lists of one length as a matrix of doubles."""
    if not rows:
        return np.empty((0, 0))
    flat = pa.chunked_array([c.flatten() for c in lists.chunks]).to_numpy().astype(np.float64)
    return flat.reshape(rows, -1)


def columns_of(table: pa.Table) -> dict[str, np.ndarray]:
    return {
        name: matrix(column, table.num_rows) if pa.types.is_list(column.type) else column.to_numpy()
        for name, column in zip(table.column_names, table.columns)
    }


def group_counts(n: int, queries: int) -> tuple[int, int]:
    """Groups of queries and of candidates."""
    candidate_size = min(max(n // GROUPS, SMALLEST_GROUP), LARGEST_GROUP)
    return max(1, -(-queries // LARGEST_GROUP)), max(1, -(-n // candidate_size))


def numbers(start: int, end: int) -> Column:
    return F.sequence(F.lit(start).cast("long"), F.lit(end - 1).cast("long"))


def block_search(rows: DataFrame, is_query: Column, k: int, search: Search, score: str, scratch: Scratch) -> DataFrame:
    """``query_id, rank, vec_id, score`` from ``rows(id, width, ...)``, which is a stored table.

    The larger the score the better, ties go to the smaller id; a row is no candidate
    of its own, and rows of different width never meet. ``search`` returns at least
    the candidates of a unit that are among the ``k`` best of it and reach the floor.
    """
    n, queries = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    query_groups, groups = group_counts(n, queries)
    q_group = F.pmod(F.xxhash64("id"), F.lit(query_groups)).alias("q_group")
    c_group = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(groups)).alias("c_group")
    asked, offered = rows.where(is_query).select("*", q_group), rows.select("*", c_group)
    unit = ["q_group", "c_group", "width"]
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64() if score == "long" else pa.float64())])

    def run(query_rows: pa.Table, candidate_rows: pa.Table) -> pa.Table:
        if not query_rows.num_rows or not candidate_rows.num_rows:
            return out.empty_table()
        found = search(columns_of(query_rows), columns_of(candidate_rows), query_rows["floor"].to_numpy())
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(found, out)], schema=out)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best: DataFrame | None = None
    start, end = 0, 1
    while start < groups:
        end = min(end, groups)
        if best is None:
            floor = asked.withColumn("floor", F.lit(None).cast(score))
        else:
            kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
            floor = asked.join(kth, "id", "left")
        floor = floor.withColumn("floor", F.coalesce("floor", F.lit(-(2**63) if score == "long" else float("-inf")).cast(score)))
        sent = floor.withColumn("c_group", F.explode(numbers(start, end)))
        part = offered.where((F.col("c_group") >= start) & (F.col("c_group") < end))
        part = part.withColumn("q_group", F.explode(numbers(0, query_groups)))
        sent = sent.toDF(*sent.columns)  # columns of its own, as both sides come from one table
        found = sent.groupBy(*unit).cogroup(part.groupBy(*unit)).applyInArrow(run, f"query_id long, vec_id long, score {score}")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = scratch.store(ranked, "best").df
        start, end = end, end * WAVE
    return best.select("query_id", "rank", "vec_id", "score")
