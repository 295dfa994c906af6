"""Random and repeatable splits of an example table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the defaults: 60 % train, 40 % test, seed 11.
WEIGHTS = (0.6, 0.4)
SEED = 11

HASH_MULTIPLIER = 2654435761
HASH_RANGE = 1 << 32


def random_split(df: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = SEED) -> list[DataFrame]:
    """Spark's own random split; its outcome depends on the partitioning."""
    return df.randomSplit(list(weights), seed=seed)


def unit_hash(key: Column, seed: int = SEED) -> Column:
    """An integer key to [0, 1). The same on any layout and any engine."""
    folded = F.pmod(key.cast("bigint"), F.lit(HASH_RANGE))
    # Two halves, so that the product stays below 2^63 for every key.
    low = F.pmod(folded, F.lit(1 << 16)) * F.lit(HASH_MULTIPLIER)
    high = F.pmod(
        F.shiftright(folded, 16) * F.lit(HASH_MULTIPLIER), F.lit(1 << 16)
    ) * F.lit(1 << 16)
    return F.pmod(low + high + F.lit(seed), F.lit(HASH_RANGE)) / F.lit(float(HASH_RANGE))


def hash_split(
    df: DataFrame, key: str, weights: Sequence[float] = WEIGHTS, seed: int = SEED
) -> list[DataFrame]:
    """Split by a hash of an integer key: a row stays on its side for good.

    Rows without a key have that of 0: every row is in one part.
    """
    total, low, parts = sum(weights), 0.0, []
    position = unit_hash(F.coalesce(F.col(key).cast("bigint"), F.lit(0)), seed)
    for i, weight in enumerate(weights):
        high = 1.0 if i == len(weights) - 1 else low + weight / total
        parts.append(df.where((position >= low) & (position < high)))
        low = high
    return parts
