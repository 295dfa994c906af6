import numpy as np
import pytest
from pyspark.sql import functions as F

from odd_rows import with_clashes
from fitframe.llm.quality import fit_additive, labelled_sample, quality_scores, sample_features, text_features
from fitframe.llm.toxicity import LabelModel, toxicity_scores, without_toxic


def area(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    ones = labels == 1
    return (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.mark.parametrize("operator, label", [(quality_scores, "quality"), (toxicity_scores, "toxic")])
def test_held_out_rows(spark, small, operator, label):
    documents, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    scored = operator(documents, labels)
    found = scored.where("held_out").join(labels, "doc_id").select("score", F.col(label).alias("y")).dropna().toPandas()
    assert len(found) > 30 and area(found["score"].to_numpy(), found["y"].to_numpy()) > 0.85
    assert scored.count() == documents.count()


@pytest.mark.parametrize("operator", [quality_scores, toxicity_scores])
def test_odd_rows(odd_documents, odd_labels, no_documents, no_labels, operator):
    documents = with_clashes(odd_documents)
    for labels in (odd_labels, no_labels):
        rows = operator(documents, labels).collect()
        assert len(rows) == odd_documents.count()
        assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
        assert not [r for r in rows if r["doc_id"] is None][0]["held_out"]
    assert operator(no_documents, odd_labels).count() == 0


def test_toxic_rows_go(spark, small, odd_documents, odd_labels):
    documents, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    kept = without_toxic(documents, labels)
    assert kept.columns == documents.columns
    marked = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {r["toxic"]: r["share"] for r in marked.join(kept.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left")
             .groupBy("toxic").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()}
    assert share[0] > 0.97 and share[1] < 0.3
    assert without_toxic(odd_documents, odd_labels).columns == odd_documents.columns


def by_hand(model, x):
    """The score of one row: every table entry found by comparing with each cut."""
    total = model.offset
    for value, cuts, table in zip(x, model.cuts, model.tables):
        total += table[sum(value >= c for c in cuts)]
    for (i, j), table in model.pairs.items():
        total += table[sum(x[i] >= c for c in model.coarse[i])][sum(x[j] >= c for c in model.coarse[j])]
    return 1 / (1 + np.exp(-total))


def test_quality_scores_are_sums_of_table_entries(spark, small):
    documents, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"]: r["score"] for r in quality_scores(documents, labels).collect()}
    sample = labelled_sample(labels, "quality", 5, 0, 20_000)
    model = fit_additive(*sample_features(documents, sample, 20_000))
    assert len(model.pairs) == 4 and any(t.any() for t in model.pairs.values())
    rows = documents.select("doc_id", "text").limit(200).collect()
    assert all(abs(found[r["doc_id"]] - by_hand(model, text_features(r["text"] or ""))) < 1e-12 for r in rows)


def test_a_pair_of_features_is_learnt():
    """Labels that only two features together tell apart."""
    x = np.random.default_rng(3).uniform(size=(3000, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = fit_additive(x[:2000], y[:2000])
    assert (1, 3) in model.pairs
    assert area(model.score(x[2000:]), y[2000:]) > 0.95
    assert np.allclose(model.score(x[:50]), [by_hand(model, row) for row in x[:50]])


def test_posteriors_by_enumeration():
    """Each class's likelihood of a row of votes, vote by vote, and Bayes' rule."""
    rng = np.random.default_rng(11)
    truth = rng.uniform(size=800) < 0.2
    right = rng.uniform(size=(800, 5)) < [0.9, 0.85, 0.8, 0.7, 0.95]
    cast = np.where(rng.uniform(size=(800, 5)) < 0.2, 0, np.where(truth[:, None] == right, 1, -1))
    model = LabelModel(cast, 0.2)
    assert np.allclose(model.rates.sum(1), 1)
    posterior = model.posterior(cast)
    for row, p in zip(cast[:100], posterior):
        weight = [1 - model.prior, model.prior]
        for k in (0, 1):
            for voter, vote in enumerate(row):
                weight[k] *= model.rates[k, vote + 1, voter] ** model.share[voter]
        assert abs(p - weight[1] / sum(weight)) < 1e-9
    assert area(posterior, truth.astype(int)) > 0.97
    # A voter that is repeated counts less each time.
    twice = LabelModel(np.hstack([cast, cast[:, :1], cast[:, :1]]), 0.2)
    assert twice.share[0] < 0.5 * model.share[0]
