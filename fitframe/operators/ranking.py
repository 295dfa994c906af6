"""ROC curve and the area under it, by exact counts at any number of scores."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from fitframe.plans.scratch import Scratch

# Distinct scores that one sorted band may hold.
BAND_SCORES = 4_000_000
# Bands that one level of the hierarchy cuts a band of the level above into, at most.
FAN = 64
SAMPLES_PER_BAND = 100


def levels_of(bands: int, fan: int) -> tuple[int, int]:
    """How many levels it takes, and how many parts each of them makes, for that many bands."""
    levels = 1
    while fan**levels < bands:
        levels += 1
    return levels, max(1, math.ceil(round(bands ** (1 / levels), 9)))


class RankingCurve:
    """Counts per distinct score, cached until ``unpersist``.

    Equal scores share one point. The scores are cut into bands of similar
    size by sampled quantiles, and those into bands again, level by level, until
    a task can sort one. Running counts are local to a band plus the totals of
    those above it in the same band of every level, so no task sorts all the
    scores or all the bands. Where the cuts fall changes the balance, never the
    counts.
    """

    def __init__(
        self,
        scored: DataFrame,
        score: str = "score",
        label: str = "label",
        band_scores: int = BAND_SCORES,
        storage: StorageLevel = StorageLevel.MEMORY_AND_DISK,
        fan: int = FAN,
    ):
        positive = (F.col(label) > 0).cast("long")
        self._groups = (
            scored.groupBy(F.col(score).alias("score"))
            .agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
            .persist(storage)
        )
        self.num_scores = self._groups.count()
        self.num_bands = max(1, math.ceil(self.num_scores / band_scores))
        self._scratch = Scratch(scored.sparkSession)
        self._bands: list[str] = []
        self._banded = self._groups
        if self.num_bands > 1:
            self._cut(*levels_of(self.num_bands, fan))

    def _cut(self, levels: int, parts: int) -> None:
        """Add a column per level; it grows with the score within the bands of the levels above."""
        fraction = min(1.0, SAMPLES_PER_BAND * self.num_bands / self.num_scores)
        finite = F.abs("score") < math.inf
        sample = self._groups.sample(fraction, seed=1).where(finite).select("score")
        quantiles = F.percentile_approx("score", [i / parts for i in range(1, parts)], 100 * parts)
        for level in range(levels):
            above, name = list(self._bands), f"band_{level}"
            # Stored: both sides of a later join must see the same cuts.
            cuts = self._scratch.store(sample.groupBy(*above).agg(quantiles.alias("cuts")), name).df
            place = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("score"))), F.lit(0))
            self._banded, sample = (self._with_cuts(df, cuts, above, name, place) for df in (self._banded, sample))
            self._bands.append(name)

    @staticmethod
    def _with_cuts(df: DataFrame, cuts: DataFrame, above: list[str], name: str, place: Column) -> DataFrame:
        if above:
            joined = df.join(cuts, above, "left")
        else:
            joined = df.withColumn("cuts", F.lit(cuts.first()["cuts"] or []).cast("array<double>"))
        return joined.withColumn(name, F.when(F.col("cuts").isNull(), 0).otherwise(place)).drop("cuts")

    def counts(self) -> DataFrame:
        """``(score, pos, neg, pos_above, neg_above)``, a row per distinct score."""
        above = (
            Window.partitionBy(*self._bands)
            .orderBy(F.col("score").desc())
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        sides = ("pos", "neg")
        local = self._banded.select(
            "score",
            *self._bands,
            *sides,
            *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in sides),
        )
        for level, name in enumerate(self._bands):
            within = self._bands[: level + 1]
            totals = self._banded.groupBy(*within).agg(*(F.sum(c).alias(f"total_{c}") for c in sides))
            # A band has a bounded number of parts, so a bounded number of rows are sorted together.
            higher = (
                Window.partitionBy(*within[:-1])
                .orderBy(F.col(name).desc())
                .rowsBetween(Window.unboundedPreceding, -1)
            )
            offsets = totals.select(
                *within, *(F.coalesce(F.sum(f"total_{c}").over(higher), F.lit(0)).alias(f"offset_{c}") for c in sides)
            )
            sums = {f"{c}_above": F.col(f"{c}_above") + F.col(f"offset_{c}") for c in sides}
            local = local.join(offsets, within).withColumns(sums).drop(*(f"offset_{c}" for c in sides))
        return local.drop(*self._bands)

    def _totals(self) -> tuple[Column, Column]:
        pos = self._groups.agg(F.sum("pos")).scalar()
        neg = self._groups.agg(F.sum("neg")).scalar()
        return pos, neg

    def points(self) -> DataFrame:
        """``(threshold, fpr, tpr)``; a side without examples has rate 0."""
        pos, neg = self._totals()
        return self.counts().select(
            F.col("score").alias("threshold"),
            F.coalesce(
                F.try_divide(F.col("neg_above") + F.col("neg"), neg), F.lit(0.0)
            ).alias("fpr"),
            F.coalesce(
                F.try_divide(F.col("pos_above") + F.col("pos"), pos), F.lit(0.0)
            ).alias("tpr"),
        )

    def area(self) -> DataFrame:
        """One row ``(auc, positives, negatives)``.

        Each negative counts the positives above it, plus half of those tied
        with it. Without negatives the area is 1, without positives 0.
        """
        won = F.col("neg") * (F.col("pos_above") + F.col("pos") / 2)
        sums = self.counts().agg(
            F.sum(won).alias("won"),
            F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"),
            F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"),
        )
        share = F.col("won") / F.col("positives") / F.col("negatives")
        auc = (
            F.when(F.col("negatives") == 0, F.lit(1.0))
            .when(F.col("positives") == 0, F.lit(0.0))
            .otherwise(share)
        )
        return sums.select(auc.alias("auc"), "positives", "negatives")

    def unpersist(self) -> None:
        self._groups.unpersist()
        self._scratch.discard_all()


def area_under_roc(scored: DataFrame, score: str = "score", label: str = "label") -> float:
    """The area as a number; nothing stays cached."""
    curve = RankingCurve(scored, score, label)
    try:
        return curve.area().first()["auc"]
    finally:
        curve.unpersist()
