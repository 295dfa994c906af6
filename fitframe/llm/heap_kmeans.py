"""Centroid clustering of integer vectors with heap-ordered bounds.

Rounds are those of Lloyd's method, to the last digit, without comparing every vector
with every centroid each time. When a vector is compared, its gap is by how much its
second nearest centroid is farther than its nearest. A round that moves the centroids
can close the gap by no more than the drift of its own centroid and the largest drift
of another. These are added up per cluster, and a vector's key is its gap plus what
its cluster had added up at the time. While the key is above the cluster's sum, the
vector cannot have changed sides. So each cluster's heap of keys is popped until its
top is above the sum; only what was popped is compared with all centroids, exactly,
and pushed on the heap of its cluster.

The vectors are stored in blocks, bucketed by block, and never move. A round joins them
with their heaps, which are bucketed alike, so neither side is shuffled, and writes the
next heaps together with what the round's moves change in the clusters' sums and counts.
Only these changes, centroids and drifts pass through the driver; their number depends
on clusters and dimensions alone.

Defined cases: vectors that are null, of another length, or hold null or non-finite
components (or some beyond ``LARGEST``, whose squares a double cannot hold) take no part; zero vectors do. Rows
that share an id are vectors of their own; rows without an id are clustered too, and
start a cluster only when there are too few others. With fewer vectors than clusters
each starts one. Equal distances go to the smaller number. Distances that pass 64 bits
are null. Columns other than the two named ones are left aside.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fitframe.llm.blocks import matrix, whole_below
from fitframe.llm.common import map_rows
from fitframe.plans.scratch import Scratch

BLOCK = 2048
BUCKET = 1 << 16
#: Buckets that a small table is dealt into, as far as that leaves none below half a block.
BUCKETS = 24
#: Components up to this size have distances that fit 64 bits, in any number of dimensions up to 64.
SMALL = 1 << 27
LARGEST = 1e150
ROUNDING = 1e-9

Heaps = list[list[tuple[float, int]]]


def blocks_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """Rows ``id, v`` as ``ids, known, values, wide`` of up to ``BLOCK`` vectors."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            ids = part.column(0)
            values = matrix(pa.chunked_array([part.column(1)]), part.num_rows).reshape(-1, width)
            wide = bool(np.abs(values).max() >= SMALL)
            yield (
                ids.fill_null(0).to_numpy().tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes(),
                (values if wide else values.astype(np.int32)).tobytes(), wide,
            )


def vectors_in(values: bytes, wide: bool, width: int, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids as whole numbers, unbounded ones where 64 bits might not do."""
    if wide or max((abs(x) for c in centroids for x in c), default=0) >= SMALL:
        rows = np.frombuffer(values, np.float64 if wide else np.int32).reshape(-1, width)
        return np.array([[int(x) for x in row] for row in rows.tolist()], object), np.array(centroids, object)
    return np.frombuffer(values, np.int32).reshape(-1, width).astype(np.int64), np.array(centroids, np.int64)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared, a row per vector."""
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], axis=1)


def advance(
    vectors: np.ndarray, centroids: np.ndarray, heaps: Heaps, sums: list[float]
) -> tuple[list[tuple[int, int, int]], int]:
    """Pop what has expired, compare it, and push it where it belongs now.

    Returns ``(vector, cluster before, cluster now)`` for those that changed, and how
    many were compared.
    """
    popped, before = [], []
    for cluster, heap in enumerate(heaps):
        while heap and heap[0][0] <= sums[cluster]:
            popped.append(heappop(heap)[1])
            before.append(cluster)
    return _placed(vectors, centroids, heaps, sums, popped, before), len(popped)


def first_heaps(vectors: np.ndarray, centroids: np.ndarray) -> tuple[Heaps, list[tuple[int, int, int]]]:
    heaps: Heaps = [[] for _ in centroids]
    everything = list(range(len(vectors)))
    moves = _placed(vectors, centroids, heaps, [0.0] * len(heaps), everything, [-1] * len(vectors))
    return heaps, moves


def _placed(vectors, centroids, heaps: Heaps, sums: list[float], places: list[int], before: list[int]):
    if not places:
        return []
    squared = distances(vectors[places], centroids)
    now = squared.argmin(1).tolist()
    roots = np.sort(np.sqrt(squared.astype(np.float64)), axis=1)
    nearest, second = roots[:, 0], roots[:, 1] if len(heaps) > 1 else np.full(len(places), np.inf)
    gap = second - nearest - ROUNDING * (1 + nearest + np.where(np.isinf(second), 0, second))
    for place, cluster, free in zip(places, now, gap.tolist()):
        key = free + sums[cluster]
        heappush(heaps[cluster], (key - ROUNDING * abs(key) if math.isfinite(key) else key, place))
    return [(p, b, n) for p, b, n in zip(places, before, now) if b != n]


def packed(heaps: Heaps) -> tuple[bytes, bytes, bytes]:
    """Keys, places and sizes; each heap in its own order, so that it is one again when read."""
    entries = [e for heap in heaps for e in heap]
    keys = np.array([e[0] for e in entries], np.float64)
    places = np.array([e[1] for e in entries], np.int32)
    return keys.tobytes(), places.tobytes(), np.array([len(h) for h in heaps], np.int32).tobytes()


def unpacked(keys: bytes, places: bytes, sizes: bytes) -> Heaps:
    entries = list(zip(np.frombuffer(keys, np.float64).tolist(), np.frombuffer(places, np.int32).tolist()))
    ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
    return [entries[start:end] for start, end in zip([0, *ends], ends)]


def changes(vectors: np.ndarray, moves: list[tuple[int, int, int]], k: int) -> Iterator[tuple[int, int, int]]:
    """``cluster, place, change`` of sums and counts; the count has the place after the last component."""
    total = {c: [0] * (vectors.shape[1] + 1) for c in {c for m in moves for c in m[1:]} if c >= 0}
    by_pair: dict[tuple[int, int], list[int]] = {}
    for place, before, now in moves:
        by_pair.setdefault((before, now), []).append(place)
    for (before, now), places in by_pair.items():
        moved = [*vectors[places].sum(0).tolist(), len(places)]
        for cluster, sign in ((before, -1), (now, 1)):
            if cluster >= 0:
                total[cluster] = [t + sign * m for t, m in zip(total[cluster], moved)]
    for cluster, values in total.items():
        yield from ((cluster, place, value) for place, value in enumerate(values) if value)


class Clusters:
    """Centroids, their exact sums and counts, and the drift added up per cluster."""

    def __init__(self, starts: list[list[int]]):
        self.centroids = starts
        self.sums = [[0] * (len(starts[0]) + 1) for _ in starts]
        self.drift = [0.0] * len(starts)

    def update(self, rows: list) -> None:
        for cluster, place, change in rows:
            self.sums[cluster][place] += int(change)
        moved = []
        for c, (total, old) in enumerate(zip(self.sums, self.centroids)):
            new = [s // total[-1] for s in total[:-1]] if total[-1] else old
            moved.append(math.sqrt(sum((a - b) ** 2 for a, b in zip(old, new))) * (1 + ROUNDING))
            self.centroids[c] = new
        for c in range(len(moved)):
            others = max((m for j, m in enumerate(moved) if j != c), default=0.0)
            self.drift[c] = (self.drift[c] + moved[c] + others) * (1 + ROUNDING)


def clustered(
    vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, factor: float = 1024.0, seed: str = "3",
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    v = F.transform(F.col(vector), lambda x: whole_below(x.cast("double") * F.lit(factor)))
    rows = vectors.where(F.size(vector) == width).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    rows = scratch.store(rows.where(whole), "kept").df
    out = "vec_id long, cluster int, distance long"
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = rows.orderBy(F.asc_nulls_last(hashed), "v").limit(k).collect()
    if not starts:
        return spark.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string")
    clusters = Clusters([[int(x) for x in r["v"]] for r in starts])
    k = len(starts)

    n = rows.count()
    buckets = max(1, min(2 * n // BLOCK, BUCKETS), -(-n // BUCKET))
    blocks = map_rows(
        rows, lambda b: blocks_of(b, width), "ids binary, known binary, values binary, wide boolean",
        pa.schema([("ids", pa.binary()), ("known", pa.binary()), ("values", pa.binary()), ("wide", pa.bool_())]),
    ).withColumn("block", F.monotonically_increasing_id())
    blocks = scratch.store_bucketed(blocks, "blocks", ["block"], buckets).df
    state = None
    for _ in range(rounds):
        after = scratch.store_bucketed(
            _round(blocks, state and state.df, clusters, width), "heaps", ["block"], buckets, aligned=True
        )
        if state:
            scratch.discard(state)
        state = after
        change = after.df.select(F.explode("changes").alias("c")).groupBy("c.cluster", "c.place")
        clusters.update(change.agg(F.sum(F.col("c.change").cast("decimal(38,0)"))).collect())

    final = _final(blocks, state and state.df, clusters, width)
    final = scratch.store(final, "assigned").df
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in clusters.centroids]
    sums = final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    totals = {r["cluster"]: r["total"] for r in sums.collect()}
    inertia = None if None in totals.values() else sum(totals.values())
    # At most as many rows as clusters.
    about = [(c, _long(totals.get(c)), _long(inertia), sha) for c, sha in enumerate(shas)]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _long(x) -> int | None:
    return int(x) if x is not None and x < 2**63 else None


def _with_heaps(blocks: DataFrame, state: DataFrame | None) -> DataFrame:
    """Blocks and their heaps, null before the first round; without a shuffle, as both are bucketed alike."""
    if state is None:
        none = F.lit(None).cast("binary")
        return blocks.select("*", none.alias("keys"), none.alias("places"), none.alias("sizes"))
    return blocks.join(state.select("block", "keys", "places", "sizes").hint("shuffle_hash"), "block")


def _opened(row: dict, width: int, centroids: list[list[int]], sums: list[float]):
    """The block's vectors, the centroids, its heaps brought up to date, and the moves."""
    vectors, points = vectors_in(row["values"], row["wide"], width, centroids)
    if row["keys"] is None:
        heaps, moves = first_heaps(vectors, points)
        return vectors, points, heaps, moves, len(vectors)
    heaps = unpacked(row["keys"], row["places"], row["sizes"])
    moves, compared = advance(vectors, points, heaps, sums)
    return vectors, points, heaps, moves, compared


def _round(blocks: DataFrame, state: DataFrame | None, clusters: Clusters, width: int) -> DataFrame:
    centroids, sums = [list(c) for c in clusters.centroids], list(clusters.drift)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                vectors, _, heaps, moves, compared = _opened(row, width, centroids, sums)
                change = [{"cluster": c, "place": p, "change": str(x)} for c, p, x in changes(vectors, moves, len(centroids))]
                yield row["block"], *packed(heaps), compared, change

    change = pa.list_(pa.struct([("cluster", pa.int32()), ("place", pa.int32()), ("change", pa.string())]))
    arrow = pa.schema([
        ("block", pa.int64()), ("keys", pa.binary()), ("places", pa.binary()), ("sizes", pa.binary()),
        ("compared", pa.int64()), ("changes", change),
    ])
    return map_rows(
        _with_heaps(blocks, state), run,
        "block long, keys binary, places binary, sizes binary, compared long, "
        "changes array<struct<cluster: int, place: int, change: string>>", arrow,
    )


def _final(blocks: DataFrame, state: DataFrame | None, clusters: Clusters, width: int) -> DataFrame:
    centroids, sums = [list(c) for c in clusters.centroids], list(clusters.drift)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                vectors, points, heaps, _, _ = _opened(row, width, centroids, sums)
                own = np.empty(len(vectors), np.int32)
                for cluster, heap in enumerate(heaps):
                    own[[place for _, place in heap]] = cluster
                squared = ((vectors - points[own]) ** 2).sum(1).tolist()
                ids = np.frombuffer(row["ids"], np.int64).tolist()
                known = np.frombuffer(row["known"], bool).tolist()
                for at, there, cluster, d in zip(ids, known, own.tolist(), squared):
                    yield at if there else None, cluster, d if d < 2**63 else None

    arrow = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
    return map_rows(_with_heaps(blocks, state), run, "vec_id long, cluster int, distance long", arrow)
