import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from odd_rows import with_clashes
from fitframe.llm import heap_kmeans as hk
from fitframe.llm.blocks import group_counts
from fitframe.llm.pivot_search import pivot_search, search_block

VECTORS = "vec_id long, embedding array<float>"


def brute_kmeans(rows, k=8, rounds=10, width=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else sha(f"3:{r[0]}"), r[1]))
    centroids = [v for _, v in order[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((square(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        own = [j for _, j in assign()]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    final = assign()
    inertia = [sum(d for d, o in final if o == j) for j in range(len(centroids))]
    shas = [sha(",".join(map(str, c))) for c in centroids]
    long = lambda x: x if x < 2**63 else None
    return [(i, j, long(d), long(inertia[j]), long(sum(inertia)), shas[j]) for (i, _), (d, j) in zip(kept, final)]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


def odd_vectors(width=64):
    one = [0.25] * width
    return [
        (1, one), (1, one), (2, one), (3, None), (4, []), (5, [0.0] * width), (6, [float("nan")] * width),
        (7, [float("inf")] + one[1:]), (8, [None] + one[1:]), (9, [1.0, 2.0]), (None, [-0.5] * width), (100, [-0.0005] * width),
        (50, [3.0] * width), (150, one),
    ]


@pytest.mark.parametrize("spread", [0.3, 0.02])
def test_kmeans_by_brute_force(spark, spread):
    random = np.random.default_rng(7)
    centers = random.normal(size=(6, 64)) * spread
    rows = [(i, (centers[i % 6] + random.normal(size=64) * 0.1).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + odd_vectors()
    table = with_clashes(spark.createDataFrame(rows, VECTORS))
    assert in_order(map(tuple, hk.clustered(table).collect())) == in_order(brute_kmeans(rows))


def test_kmeans_over_blocks_and_few_rows(spark, monkeypatch):
    random = np.random.default_rng(1)
    rows = [(i, random.normal(size=64).astype(np.float32).tolist()) for i in range(400)]
    monkeypatch.setattr(hk, "BLOCK", 32)
    wanted = in_order(brute_kmeans(rows))
    for parts in (1, 5):
        found = hk.clustered(spark.createDataFrame(rows, VECTORS).repartition(parts))
        assert in_order(map(tuple, found.collect())) == wanted
    few = odd_vectors()[:8]
    assert in_order(map(tuple, hk.clustered(spark.createDataFrame(few, VECTORS)).collect())) == in_order(brute_kmeans(few))
    assert hk.clustered(spark.createDataFrame([], VECTORS)).count() == 0


def test_kmeans_of_large_components(spark):
    random = np.random.default_rng(2)
    rows = [(i, (random.normal(size=64) * 10.0 ** random.integers(0, 16)).astype(np.float32).tolist()) for i in range(60)]
    found = hk.clustered(spark.createDataFrame(rows, VECTORS)).collect()
    assert in_order(map(tuple, found)) == in_order(brute_kmeans(rows))


def test_heaps_spare_comparisons():
    random = np.random.default_rng(0)
    centers = random.integers(-1000, 1000, size=(8, 64))
    vectors = centers[random.integers(0, 8, 2000)] + random.integers(-100, 100, size=(2000, 64))
    clusters = hk.Clusters(vectors[:8].tolist())
    heaps, moves = hk.first_heaps(vectors, np.array(clusters.centroids))
    compared = []
    for _ in range(12):
        clusters.update(list(hk.changes(vectors, moves, 8)))
        heaps = hk.unpacked(*hk.packed(heaps))
        moves, n = hk.advance(vectors, np.array(clusters.centroids), heaps, clusters.drift)
        compared.append(n)
        own = {place: c for c, heap in enumerate(heaps) for _, place in heap}
        exact = hk.distances(vectors, np.array(clusters.centroids)).argmin(1).tolist()
        assert [own[i] for i in range(2000)] == exact
    assert compared[-1] == 0 and sum(compared) < 12 * 2000 * 0.7


def brute_products(rows, every, k, factor=256):
    kept = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            kept[i] = min(kept.get(i, v), v)
    whole = {i: [math.floor(factor * x) for x in v] for i, v in kept.items()}
    found = []
    for q in whole:
        if q % every == 0:
            scores = [(-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q and len(w) == len(whole[q])]
            scores = [(max(min(s, 2**63), 1 - 2**63), i) for s, i in scores]
            found += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found)


def test_pivots_by_brute_force(spark):
    random = np.random.default_rng(4)
    centers = random.normal(size=(10, 16))
    rows = [(i, (centers[i % 10] + random.normal(size=16) * 0.2).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[100][1]) for i in range(40)] + odd_vectors(16)
    table = with_clashes(spark.createDataFrame(rows, VECTORS))
    for every, k in ((50, 5), (300, 2000)):
        assert sorted(map(tuple, pivot_search(table, every, k).collect())) == brute_products(rows, every, k)
    assert pivot_search(spark.createDataFrame([], VECTORS)).count() == 0


def test_pivots_of_large_components(spark):
    random = np.random.default_rng(6)
    rows = [(i, (random.normal(size=8) * 10.0 ** random.integers(0, 30)).astype(np.float32).tolist()) for i in range(120)]
    found = pivot_search(spark.createDataFrame(rows, VECTORS), 10, 5)
    assert sorted(map(tuple, found.collect())) == brute_products(rows, 10, 5)


def test_pivots_stop_early():
    random = np.random.default_rng(0)
    centers = random.normal(size=(20, 64)) * 40
    vectors = np.rint(centers[random.integers(0, 20, 4000)] + random.normal(size=(4000, 64)))
    from fitframe.llm import pivot_search as ps

    near = ps.pivot_table(vectors, ps.far_apart(vectors[:500], 24))
    looked = []
    real = ps.exact_products
    ps.exact_products = lambda c, q, e: looked.append(len(c)) or real(c, q, e)
    try:
        side = {"id": np.arange(4000), "v": vectors, "near": near}
        head = {name: column[:50] for name, column in side.items()}
        q, c, s = search_block(head, side, np.full(50, -(2**63)), 5)
    finally:
        ps.exact_products = real
    assert sum(looked) < 50 * 4000 * 0.5
    scores = (vectors[:50] @ vectors.T).astype(np.int64)
    for i in range(50):
        order = [j for j in np.lexsort((np.arange(4000), -scores[i])) if j != i][:5]
        assert sorted(c[q == i]) == sorted(order)


def test_group_counts():
    assert group_counts(0, 0) == (1, 1)
    assert group_counts(10**9, 2 * 10**7) == (611, 30518)
    assert group_counts(51_282, 1026) == (1, 65)
