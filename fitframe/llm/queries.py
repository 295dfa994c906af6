"""The operators of this subpackage over the standard tables, whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from fitframe.llm.bpe import encoded
from fitframe.llm.collocations import collocations
from fitframe.llm.fingerprints import fingerprints
from fitframe.llm.heap_kmeans import clustered
from fitframe.llm.licenses import license_scan
from fitframe.llm.line_dedup import deduplicated
from fitframe.llm.mixing import mix
from fitframe.llm.neighbours import nearest
from fitframe.llm.ngram_join import near_duplicates
from fitframe.llm.pivot_search import pivot_search
from fitframe.llm.quality import quality_scores
from fitframe.llm.toxicity import toxicity_scores
from fitframe.llm.url_filter import judged_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


def op3_nearest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))


def op4_mixing(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return mixed.select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_total").alias("source_size"),
        F.col("_mix_target").alias("target"),
        F.col("_mix_taken").alias("taken"),
    )


def op5_licenses(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark, sf_dir):
    """Texts without repeated lines, with how many lines each had and lost."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    found = deduplicated(documents.withColumn("n_lines", lines.cast("long")))
    return found.select("doc_id", "n_lines", "n_removed", "text")


def op9_bpe(spark, sf_dir):
    return bpe_digests(encoded(table(spark, sf_dir, "documents"), corpus_pipeline.tokenizer_path()))


def bpe_digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_url_filter(spark, sf_dir):
    return judged_urls(*(table(spark, sf_dir, name) for name in ("pages", "documents", "labels")))


def op11_heap_kmeans(spark, sf_dir):
    return clustered(table(spark, sf_dir, "embeddings"))


def op12_pivot_search(spark, sf_dir):
    return pivot_search(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_fingerprints, op3_nearest, op4_mixing, op5_licenses,
        op6_ngram_join, op7_toxicity, op8_line_dedup, op9_bpe, op10_url_filter,
        op11_heap_kmeans, op12_pivot_search, op13_collocations,
    )
} | {"pipeline": corpus_pipeline.run}
