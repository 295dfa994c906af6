"""Exact largest inner products of integer vectors, by a table of distances to pivots.

The distances of every vector to a few pivots are computed once. For a query q, a
candidate c and any pivot p, |q - c| is at least the difference of their distances
to p; the largest of these over all pivots bounds |q - c| from below, hence

    q.c = (|q|^2 + |c|^2 - |q - c|^2) / 2

from above. A query's candidates are evaluated in the order of that bound, a few at a
time, until the bound of the next one is below the k-th score found: no candidate
after it can enter the result. The origin is always a pivot (its distances are the
norms); the others are the vectors of a sample that lie farthest apart. Pivots decide
how early a search stops and never what it returns. Units of work are blocks of
queries against blocks of candidates, see ``blocks``.

Defined cases: vectors that are null or empty, or hold null or non-finite components,
take no part, nor do rows without an id; zero vectors do. Of rows that share an id the
one with the least vector counts. Vectors of different length are never compared. Ties
go to the smaller id; with fewer than ``k`` candidates all are returned. Scores are
exact while they fit 64 bits and stay at the largest or least such number beyond.
Components that overflow a double when multiplied count as non-finite. Columns other than the two named ones are left aside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fitframe.llm.blocks import block_search, matrix, usable_vectors, whole_below
from fitframe.plans.scratch import Scratch

PIVOTS = 32
SAMPLE = 1024
FIRST_LOOK = 64
#: Whole numbers up to this size are exact in double precision.
EXACT = float(1 << 53)
#: Distances are stored in single precision.
SINGLE = 2.0**-22


def far_apart(sample: np.ndarray, most: int) -> np.ndarray:
    """The vectors of ``sample`` that a farthest-first walk from the origin meets first."""
    nearest = np.sqrt((sample**2).sum(1))
    chosen = []
    while len(chosen) < min(most, len(sample)) and nearest.max() > 0:
        chosen.append(sample[int(np.argmax(nearest))])
        nearest = np.minimum(nearest, np.sqrt(((sample - chosen[-1]) ** 2).sum(1)))
    return np.array(chosen).reshape(len(chosen), sample.shape[1])


def pivot_table(vectors: np.ndarray, pivots: np.ndarray | None) -> np.ndarray:
    """A row of distances per vector: to the origin, then to every pivot."""
    norms = (vectors**2).sum(1)
    table = [np.sqrt(norms)]
    for p in [] if pivots is None else pivots:
        table.append(np.sqrt(((vectors - p) ** 2).sum(1)))
    return np.array(table, np.float32).T


def exact_products(candidates: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (candidates @ query).astype(np.int64)
    y = [int(b) for b in query]
    sums = [sum(int(a) * b for a, b in zip(row, y)) for row in candidates]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums], np.int64)


def search_block(
    queries: dict[str, np.ndarray], candidates: dict[str, np.ndarray], floors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y, near_x, near_y = queries["v"], candidates["v"], queries["near"], candidates["near"]
    ids = candidates["id"]
    size_x, size_y = (x**2).sum(1), (y**2).sum(1)
    # No sum of products of two rows is larger than the product of their lengths.
    exact = np.sqrt(size_x.max()) * np.sqrt(size_y.max()) * 2 < EXACT
    across = np.ascontiguousarray(near_y.T)
    found = []
    for i, query_id in enumerate(queries["id"]):
        with np.errstate(invalid="ignore", over="ignore"):
            apart = np.abs(across - near_x[i][:, None]).max(0) - SINGLE * (near_x[i].max() + near_y.max())
            upper = (size_x[i] + size_y - np.maximum(apart, 0) ** 2) / 2 + 1e-9 * (size_x[i] + size_y) + 1e-6
        # Lengths beyond double precision bound nothing.
        upper[~np.isfinite(upper)] = np.inf
        floor = int(floors[i])
        left = np.flatnonzero((upper >= floor) & (ids != query_id))
        left = left[np.argsort(-upper[left], kind="stable")]
        best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
        at, step = 0, FIRST_LOOK
        while at < len(left) and upper[left[at]] >= floor:
            looked = left[at : at + step]
            scores = exact_products(y[looked], x[i], exact)
            reach = scores >= floor
            best_ids = np.concatenate([best_ids, ids[looked[reach]]])
            best = np.concatenate([best, scores[reach]])
            if len(best) > k:
                # Not by minus the score, which the least number does not have.
                kept = np.lexsort((-best_ids, best))[: -k - 1 : -1]
                best_ids, best = best_ids[kept], best[kept]
            if len(best) == k:
                floor = max(floor, int(best.min()))
            at, step = at + step, step * 2
        found.append((np.full(len(best), query_id), best_ids, best))
    return tuple(np.concatenate(column) for column in zip(*found))


def pivot_search(
    vectors: DataFrame, every: int = 50, k: int = 5, factor: float = 256.0, pivots: int = PIVOTS,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of floor(factor * x).

    Queries are the rows whose id is divisible by ``every``; every other row is a candidate.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    whole = F.transform("v", lambda x: whole_below(x.cast("double") * F.lit(factor)))
    coded = usable_vectors(vectors, key, vector, zeros=True).withColumn("v", whole)
    coded = coded.where(F.forall("v", lambda x: F.abs(x) < float("inf")))
    coded = scratch.store(coded, "coded").df
    # A fixed number of rows, for the choice of pivots only.
    sample = coded.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"].to_pylist()
    of_width: dict[int, np.ndarray] = {}
    for width in sorted({len(v) for v in sample}):
        of_width[width] = far_apart(np.array([v for v in sample if len(v) == width]), pivots)

    @F.arrow_udf("array<float>")
    def distances(v: pa.Array) -> pa.Array:
        widths = np.diff(v.offsets.to_numpy())
        table: list[np.ndarray | None] = [None] * len(v)
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            own = pa.chunked_array([v.take(pa.array(rows))])
            for row, near in zip(rows.tolist(), pivot_table(matrix(own, len(rows)), of_width.get(width))):
                table[row] = near
        return pa.array(table, pa.list_(pa.float32()))

    rows = scratch.store(coded.withColumn("near", distances("v")), "pivots").df
    return block_search(
        rows, F.col("id") % every == 0, k, lambda q, c, floors: search_block(q, c, floors, k), "long", scratch
    )
