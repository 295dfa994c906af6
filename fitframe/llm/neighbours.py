"""Nearest vectors by a block matrix join.

Queries and candidates meet block against block (see ``blocks``). Within a unit the
candidates go past the queries in tiles. A tile's products of int8 codes give every
inner product within a bound that follows from the vectors' own quantisation errors;
pairs that cannot reach the floor a query came with, or the nearest found so far, are
left out. The others are computed in double precision from the original vectors and
go through a heap per query; the heaps of the units are merged.
No candidate is lost: the result is that of comparing all pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows without an id; of rows that share an id the
one with the smallest vector counts; vectors of different length are never
compared; ties go to the smaller id; with fewer than ``k`` candidates all are
returned. Columns other than the two named ones are left aside.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, functions as F

from fitframe.llm.blocks import block_search, usable_vectors
from fitframe.plans.scratch import Scratch

TILE = 1024
PAIRS_AT_ONCE = 1 << 16


class Coded:
    """Vectors as int8 codes times a scale, with the norms that bound the error."""

    def __init__(self, exact: np.ndarray):
        scale = np.abs(exact).max(1) / 127
        # Vectors of denormal numbers have codes 0, and all of them as error.
        codes = np.rint(exact / np.where(scale > 0, scale, 1)[:, None])
        near = codes * scale[:, None]
        self.exact, self.scale, self.codes = exact, scale, codes.astype(np.int8)
        self.length = np.sqrt((near**2).sum(1))
        self.error = np.sqrt(((exact - near) ** 2).sum(1))

    def tile(self, at: int) -> "Coded":
        part = object.__new__(Coded)
        for name, values in vars(self).items():
            setattr(part, name, values[at : at + TILE])
        return part

    def wide_codes(self) -> np.ndarray:
        """Products of codes are whole numbers below 2^24 for up to 1040 dimensions, so
        single precision holds them exactly; longer vectors use doubles."""
        return self.codes.astype(np.float32 if self.codes.shape[1] <= 1040 else np.float64)


class Searcher:
    """The nearest candidates so far of a tile of queries of one dimension."""

    def __init__(self, ids: np.ndarray, coded: Coded, floors: np.ndarray, k: int):
        self.ids, self.k, self.coded = ids, k, coded
        self.codes = coded.wide_codes()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.floors = self.least = floors

    def add(self, ids: np.ndarray, c: Coded) -> None:
        q = self.coded
        near = (self.codes @ c.wide_codes().T).astype(np.float64) * q.scale[:, None] * c.scale
        # |x.y - x'.y'| <= |e||y'| + |x'||f| + |e||f| for x = x' + e, y = y' + f
        bound = np.outer(q.error, c.length + c.error) + np.outer(q.length, c.error)
        bound += 1e-9 * np.outer(q.length, c.length)
        reach = self.least
        if len(ids) > self.k:  # one more than k, as a query's own vector does not count
            lower = np.partition(near - bound, len(ids) - self.k - 1, axis=1)[:, len(ids) - self.k - 1]
            reach = np.maximum(reach, lower)
        row, col = np.nonzero((near + bound >= reach[:, None]) & (self.ids[:, None] != ids))
        for at in range(0, len(row), PAIRS_AT_ONCE):
            r, o = row[at : at + PAIRS_AT_ONCE], col[at : at + PAIRS_AT_ONCE]
            scores = np.einsum("ij,ij->i", q.exact[r], c.exact[o])
            for i, score, other in zip(r.tolist(), scores.tolist(), ids[o].tolist()):
                heap, entry = self.heaps[i], (score, -other)
                if score < self.floors[i]:
                    continue
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
        kth = [h[0][0] if len(h) == self.k else -np.inf for h in self.heaps]
        self.least = np.maximum(self.floors, kth)


def search_block(
    queries: dict[str, np.ndarray], candidates: dict[str, np.ndarray], floors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    asked, offered = Coded(queries["v"]), Coded(candidates["v"])
    found: list[tuple[int, int, float]] = []
    for at in range(0, len(floors), TILE):
        searcher = Searcher(queries["id"][at : at + TILE], asked.tile(at), floors[at : at + TILE], k)
        for start in range(0, len(candidates["id"]), TILE):
            searcher.add(candidates["id"][start : start + TILE], offered.tile(start))
        found += [(q, -other, score) for q, heap in zip(searcher.ids.tolist(), searcher.heaps) for score, other in heap]
    ids, others, scores = zip(*found) if found else ((), (), ())
    return np.array(ids, np.int64), np.array(others, np.int64), np.array(scores, np.float64)


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of every query.

    Queries are the rows whose id is divisible by ``every``; every other row is
    a candidate.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.store(usable_vectors(vectors, key, vector, zeros=False), "vectors").df
    return block_search(
        rows, F.col("id") % every == 0, k, lambda q, c, floors: search_block(q, c, floors, k), "double", scratch
    )
