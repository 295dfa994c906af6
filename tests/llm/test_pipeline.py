import pytest

import corpus_pipeline
from odd_rows import with_clashes
from fitframe.llm.common import BATCH_BYTES, BATCH_SETTING

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_bear_odd_and_no_rows(spark, odd_documents, no_documents, odd_labels, tmp_path):
    pytest.importorskip("public_tokenizers")
    odd_labels.write.parquet(f"{tmp_path}/labels.parquet")
    for documents in (with_clashes(odd_documents), no_documents):
        docs = documents
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, str(tmp_path))
            result.write.parquet(f"{tmp_path}/{name}-{len(documents.columns)}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{len(documents.columns)}")
            if name != "bpe":
                assert docs.columns == documents.columns
        assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert docs.count() == 0


def test_order_of_stages():
    assert list(STAGES) == ["toxicity", "line_dedup", "ngram_join", "mixing", "bpe"]


def test_stages_hand_over_small_batches(spark, no_documents):
    before = spark.conf.get(BATCH_SETTING)
    try:
        spark.conf.unset(BATCH_SETTING)
        STAGES["mixing"](spark, no_documents, "")
        assert int(spark.conf.get(BATCH_SETTING)) == BATCH_BYTES
    finally:
        spark.conf.set(BATCH_SETTING, before)
