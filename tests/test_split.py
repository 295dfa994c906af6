from pyspark.sql import functions as F

from fitframe.operators.split import hash_split, random_split, unit_hash


def test_hash_split_is_a_partition(spark):
    df = spark.range(10_000)
    parts = hash_split(df, "id", (0.5, 0.3, 0.2), seed=3)
    sizes = [p.count() for p in parts]
    assert sum(sizes) == 10_000
    assert all(abs(n / 10_000 - w) < 0.03 for n, w in zip(sizes, (0.5, 0.3, 0.2)))
    assert parts[0].intersect(parts[1]).count() == 0


def test_hash_split_ignores_layout(spark):
    df = spark.range(1000)
    one = {r["id"] for r in hash_split(df.coalesce(1), "id")[0].collect()}
    assert one == {r["id"] for r in hash_split(df.repartition(7), "id")[0].collect()}


def test_unit_hash_for_any_key(spark):
    keys = [0, 1, -1, 2**32, 2**40 + 17, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(k,) for k in keys], "id bigint")
    rows = df.select("id", unit_hash(F.col("id")).alias("u")).collect()
    assert all(r["u"] == (r["id"] * 2654435761 + 11) % 2**32 / 2**32 for r in rows)


def test_random_split(spark):
    parts = random_split(spark.range(1000))
    assert sum(p.count() for p in parts) == 1000
    assert 500 < parts[0].count() < 700
