"""From raw documents to token ids, in five stages of the llm operators.

Each stage gets what its predecessor wrote, and all but the last return the
columns of ``documents``. Toxic documents go, repeated lines go, of every group
of near copies one document stays, sources are mixed to their targets (documents
repeat as their epochs ask), and the texts are encoded.
"""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fitframe.llm.bpe import encoded
from fitframe.llm.common import BATCH_BYTES, BATCH_SETTING
from fitframe.llm.line_dedup import without_repeated_lines
from fitframe.llm.mixing import mixed_documents
from fitframe.llm.ngram_join import one_of_each
from fitframe.llm.toxicity import without_toxic
from fitframe.plans.scratch import Scratch, StoredTable, collected_tables

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    return importlib.import_module("public_tokenizers").path(TOKENIZER)


_kept: list[Scratch] = []


def stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """A stage that first deletes what earlier ones stored on their way, unless ``docs`` still reads it.

    A stage's result is written before the next stage begins. It is written after this returns,
    so the size of batches for Python functions is set for the session.
    """

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
        if _kept:
            read = docs.inputFiles()
            for scratch in [s for s in _kept if not any(s.name in path for path in read)]:
                scratch.discard_all()
                _kept.remove(scratch)
        with collected_tables() as made:
            result = function(spark, docs, sf_dir)
        _kept.extend(made)
        return result

    return run_stage


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeated_lines(docs)


@stage
def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


@stage
def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = encoded(docs, tokenizer_path())
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("mixing", mixing),
    ("bpe", bpe),
]

# Scores of a trained classifier and MinHash candidates are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again.

    Results but the last go when the next one is written.
    """
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: StoredTable | None = None
    for name, function in STAGES:
        after = scratch.store(function(spark, docs, sf_dir), name)
        if before is not None:
            scratch.discard(before)
        before, docs = after, after.df
    return docs
