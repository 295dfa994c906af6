"""The whole job: load, split, train, score, rate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fitframe.examples import Examples
from fitframe.operators.ranking import area_under_roc
from fitframe.operators.score import score
from fitframe.operators.split import SEED, WEIGHTS, hash_split, random_split
from fitframe.plans.fit import FittedModel, fit
from fitframe.sources.libsvm import read_libsvm


@dataclass(frozen=True)
class JobResult:
    model: FittedModel
    scored: DataFrame
    auc: float


def split_examples(examples: Examples) -> tuple[Examples, Examples]:
    """60/40 train and test parts, by id where there is one."""
    if examples.id_col is None:
        parts = random_split(examples.df, WEIGHTS, SEED)
    else:
        parts = hash_split(examples.df, examples.id_col, WEIGHTS, SEED)
    return examples.with_df(parts[0]), examples.with_df(parts[1])


def train_and_rate(train: Examples, test: Examples, **options) -> JobResult:
    """Fit on ``train``; score ``test`` and take the area under its ROC curve."""
    model = fit(train, **options)
    scored = score(test, model.weights)
    return JobResult(model, scored, area_under_roc(scored))


def run_job(spark: SparkSession, train_path: str, test_path: str, **options) -> JobResult:
    """From LibSVM files. The same path twice means a 60/40 split of it."""
    train = read_libsvm(spark, train_path)
    if train_path == test_path:
        train, test = split_examples(train)
    else:
        test = read_libsvm(spark, test_path, num_features=train.num_features)
    return train_and_rate(train, test, **options)
