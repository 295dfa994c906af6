import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from fitframe import RankingCurve, area_under_roc
from fitframe.operators.ranking import levels_of

from numpy_method import auc


def frame(spark, scores, labels):
    data = [(float(s), float(y)) for s, y in zip(scores, labels)]
    return spark.createDataFrame(data, "score double, label double").repartition(4)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    scores = np.round(rng.normal(size=900), 2)  # with ties
    return scores, (rng.uniform(size=900) < 1 / (1 + np.exp(-scores))).astype(float)


@pytest.mark.parametrize("band_scores", [10_000, 50, 7])
def test_area_is_exact_for_any_bands(spark, sample, band_scores):
    curve = RankingCurve(frame(spark, *sample), band_scores=band_scores)
    row = curve.area().first()
    curve.unpersist()
    assert row["auc"] == pytest.approx(auc(*sample), abs=1e-12)
    assert (row["positives"], row["negatives"]) == (sample[1].sum(), 900 - sample[1].sum())


def test_area_equals_evaluator(spark, sample):
    df = frame(spark, *sample)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
    assert area_under_roc(df) == pytest.approx(evaluator.evaluate(df), abs=1e-12)


def test_reversed_scores(spark, sample):
    scores, labels = sample
    total = area_under_roc(frame(spark, scores, labels)) + area_under_roc(frame(spark, -scores, labels))
    assert total == pytest.approx(1)


def test_points(spark):
    curve = RankingCurve(frame(spark, [0.9, 0.5, 0.5, 0.1], [1, 1, 0, 0]), band_scores=1)
    points = curve.points().orderBy("threshold", ascending=False).collect()
    assert [tuple(p) for p in points] == [(0.9, 0.0, 0.5), (0.5, 0.5, 1.0), (0.1, 1.0, 1.0)]


def test_one_hot_score_and_one_class(spark):
    assert area_under_roc(frame(spark, [0.5] * 10, [0, 1] * 5)) == 0.5
    assert area_under_roc(frame(spark, [0.1, 0.2], [1, 1])) == 1.0
    assert area_under_roc(frame(spark, [0.1, 0.2], [0, 0])) == 0.0


def test_infinite_and_nan_scores(spark):
    scores = [float("inf"), float("nan"), float("-inf"), 0.0, -0.0, 1.0]
    df = frame(spark, scores, [1, 1, 0, 1, 0, 0])
    # NaN ranks highest; the zeros are tied.
    for band_scores in (100, 2):
        assert RankingCurve(df, band_scores=band_scores).area().first()["auc"] == pytest.approx(7.5 / 9)


@pytest.mark.parametrize("fan", [2, 3])
def test_bands_of_several_levels(spark, sample, fan):
    curve = RankingCurve(frame(spark, *sample), band_scores=20, fan=fan)
    assert curve.num_bands > fan**2
    row = curve.area().first()
    counts = curve.counts().toPandas()
    curve.unpersist()
    assert row["auc"] == pytest.approx(auc(*sample), abs=1e-12)
    scores, labels = sample
    assert len(counts) == len(set(scores))
    for r in counts.itertuples():
        above = scores > r.score
        assert (r.pos_above, r.neg_above) == (labels[above].sum(), (1 - labels[above]).sum())


def test_odd_scores_on_several_levels(spark):
    scores = [float("inf"), float("nan"), float("-inf"), 0.0, -0.0, 1.0] + [2.0] * 50
    df = frame(spark, scores, [1, 1, 0, 1, 0, 0] + [0, 1] * 25)
    areas = {RankingCurve(df, band_scores=b, fan=2).area().first()["auc"] for b in (100, 1)}
    assert len(areas) == 1
    assert RankingCurve(df.where("score > 9e9"), band_scores=1).area().first()["auc"] == 1.0


def test_levels():
    assert levels_of(10, 64) == (1, 10)
    assert levels_of(64, 64) == (1, 64)
    assert levels_of(65, 64) == (2, 9)
    for bands in (2, 100, 4096, 4097, 10**6, 10**9):
        levels, parts = levels_of(bands, 64)
        assert parts <= 64 and parts**levels >= bands
