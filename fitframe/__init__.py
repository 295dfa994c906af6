"""Regularised binary linear models on Spark DataFrames."""

from fitframe.examples import Examples
from fitframe.functions.losses import LOGISTIC, Loss
from fitframe.operators.matrix import DistributedMatrix
from fitframe.operators.ranking import RankingCurve, area_under_roc
from fitframe.operators.score import linear_scores, score
from fitframe.plans.fit import FittedModel, fit
from fitframe.plans.job import run_job, train_and_rate
from fitframe.sources import (
    examples_from_array,
    examples_from_arrays,
    examples_from_columns,
    read_libsvm,
)

__all__ = [
    "DistributedMatrix",
    "Examples",
    "FittedModel",
    "LOGISTIC",
    "Loss",
    "RankingCurve",
    "area_under_roc",
    "examples_from_array",
    "examples_from_arrays",
    "examples_from_columns",
    "fit",
    "linear_scores",
    "read_libsvm",
    "run_job",
    "score",
    "train_and_rate",
]
