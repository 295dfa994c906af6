"""Toxicity by weak supervision.

Voters look at a text: fixed insults, words and word beginnings that are far
more often dense in texts labelled toxic, repeated hits, insults after "you", shouting,
and the absence of any of these. Beginnings that toxic words share also occur by chance
in long clean texts, so mined entries count by their share of a text's words. A generative label model estimates, without
looking at labels, how often each voter is right per class and which voters
agree for reasons other than the class; correlated voters share their weight.
Its posterior labels train a linear classifier on the voters' counts, which
scores every text.

Word counts and counts of votes of all texts come from Spark tasks. Only a
bounded sample's votes (``fit_rows`` rows) and a bounded lexicon
(``lexicon_size`` entries) reach the driver.

Defined cases: null and empty texts have no votes and get a score; labels other
than 0 and 1 and rows without an id are not learned from; without labels only
the fixed insults vote; repeated rows are scored once each. Columns other than
``doc_id`` and ``text`` are left aside.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fitframe.llm.common import is_held_out, map_rows, scored_by, texts_of
from fitframe.llm.quality import labelled_sample, sigmoid

# Common English insults.
INSULTS = (
    "clown creep cretin degenerate disgusting dumbass fool garbage hateful idiot idiotic imbecile jerk "
    "loser losers lowlife moron moronic parasite pathetic pig rat repulsive scum scumbag sicko stupid "
    "trash ugly vermin vile worthless wretch"
).split()

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
VOTERS = ("insults", "words", "start_4", "start_5", "start_6", "repeated", "addressed", "shouting", "dense")


@dataclass
class Lexicon:
    words: frozenset
    starts: dict[int, frozenset]


def entries_of(text: str, share: float) -> tuple[set[tuple[int, str]], set[tuple[int, str]]]:
    """Distinct words (kind 0) and word beginnings (kind: their length), and those of
    them that make up at least ``share`` of the words.
    """
    words = Counter(WORD.findall(text.lower()))
    found = Counter({(0, w): k for w, k in words.items() if len(w) <= 40})
    for w, k in words.items():
        for n in BEGINNINGS:
            if len(w) >= n:
                found[n, w[:n]] += k
    least = share * words.total()
    return set(found), {e for e, k in found.items() if k >= least}


def mined_lexicon(
    texts: DataFrame, n_toxic: int, n_clean: int, size: int, z: float, purity: float, share: float
) -> tuple[Lexicon, frozenset]:
    """Entries that are dense in more toxic texts than others, and the fixed insults
    without those that the labels contradict. ``texts`` has ``text, label``.
    """

    def rows(batches):
        for batch in batches:
            seen, dense = (Counter(), Counter()), (Counter(), Counter())
            for label, text in zip(batch.column(1).to_pylist(), texts_of(batch, 0)):
                found, often = entries_of(text, share)
                seen[label].update(found)
                dense[label].update(often)
            for entry in seen[0].keys() | seen[1].keys():
                yield *entry, *(counted[k][entry] for counted in (seen, dense) for k in (1, 0))

    names = ("toxic", "clean", "dense_toxic", "dense_clean")
    arrow = pa.schema([("kind", pa.int32()), ("entry", pa.string()), *((n, pa.int64()) for n in names)])
    counts = map_rows(texts, rows, "kind int, entry string, " + ", ".join(f"{n} long" for n in names), arrow)
    counts = counts.groupBy("kind", "entry").agg(
        *(F.sum(n).alias(short) for n, short in zip(names, ("seen_t", "seen_c", "t", "c")))
    )
    counts = counts.persist()
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    odds = F.log(t / (n_toxic + 1.0)) - F.log(c / (n_clean + 1.0))
    scored = counts.withColumn("z", odds / F.sqrt(1 / t + 1 / c))
    pure = scored.where((F.col("z") >= z) & (F.col("t") >= purity * (F.col("t") + F.col("c"))))
    top = pure.orderBy(F.desc("z"), "kind", "entry").limit(size).collect()
    listed = counts.where((F.col("kind") == 0) & F.col("entry").isin(INSULTS))
    contradicted = {r.entry for r in listed.where((F.col("seen_c") >= 5) & (F.col("seen_c") > F.col("seen_t"))).collect()}
    counts.unpersist()
    by_kind = {k: frozenset(r.entry for r in top if r.kind == k) for k in (0, *BEGINNINGS)}
    lexicon = Lexicon(by_kind[0], {n: by_kind[n] for n in BEGINNINGS})
    return lexicon, frozenset(INSULTS) - contradicted


def hits(text: str, lexicon: Lexicon, insults: frozenset, share: float) -> list[float]:
    """Counts per voter of a whole text, in the order of ``VOTERS``, then its words.

    Words and beginnings of the lexicon count where, kind by kind, they make up at
    least ``share`` of the words.
    """
    words = WORD.findall(text.lower())
    counted = Counter(words)
    listed = [w for w in counted if w in insults]
    least = share * len(words)
    dense = lambda found: found if sum(counted[w] for w in found) >= least else []
    mined = dense([w for w in counted if w in lexicon.words])
    starts = {n: dense([w for w in counted if w[:n] in s]) for n, s in lexicon.starts.items()}
    marked = set(listed).union(mined, *starts.values())
    total = sum(counted[w] for w in marked)
    # Looking behind every marked word is only needed where there is one.
    addressed = sum(a in ("you", "your") and b in marked for a, b in zip(words, words[1:])) if marked else 0
    capitals = sum(map(str.isupper, text)) / max(len(text), 1)
    return [
        float(sum(counted[w] for w in listed)),
        float(sum(counted[w] for w in mined)),
        *(float(sum(counted[w] for w in starts[n])) for n in BEGINNINGS),
        float(max(total - 1, 0)),
        float(addressed),
        float(capitals > 0.6 and len(words) > 3),
        100.0 * total / max(len(words), 1),
        float(len(words)),
    ]


def features(h: np.ndarray) -> np.ndarray:
    """Presence and damped counts of the voters' hits."""
    counts = h[:, : len(VOTERS)]
    return np.hstack([counts > 0, np.log1p(counts), np.ones((len(h), 1))]).astype(float)


def votes(h: np.ndarray) -> np.ndarray:
    """1: toxic, -1: clean, 0: no opinion; the last voter is the absence of any hit."""
    found = h[:, : len(VOTERS)]
    cast = (found > 0).astype(int)
    cast[:, VOTERS.index("dense")] = found[:, VOTERS.index("dense")] >= 1.0
    silent = np.where((found[:, : VOTERS.index("shouting")] > 0).any(1), 0, -1)
    return np.hstack([cast, silent[:, None]])


class LabelModel:
    """P(vote | class) per voter, fitted by expectation-maximisation.

    A voter's log-likelihood ratio counts 1 / (1 + sum of its positive
    correlations with other voters given the class), so voters that repeat
    each other do not add up to certainty.
    """

    def __init__(self, v: np.ndarray, prior: float, rounds: int = 25):
        self.prior = min(max(prior, 0.01), 0.5)
        p = np.where((v[:, :-1] > 0).sum(1) >= 2, 0.95, np.where((v > 0).any(1), 0.4, 0.02))
        for _ in range(rounds):
            self._maximise(v, p)
            p = self.posterior(v)

    def _maximise(self, v: np.ndarray, p: np.ndarray) -> None:
        self.rates = np.empty((2, 3, v.shape[1]))
        residuals = np.zeros(v.shape)
        for k, weight in enumerate((1 - p, p)):
            for i, vote in enumerate((-1, 0, 1)):
                self.rates[k, i] = ((v == vote) * weight[:, None]).sum(0) + 0.5
            self.rates[k] /= self.rates[k].sum(0)
            mean = self.rates[k, 2] - self.rates[k, 0]
            residuals += weight[:, None] * (v - mean)
        spread = np.sqrt((residuals**2).mean(0)) + 1e-6
        correlation = (residuals.T @ residuals) / len(v) / np.outer(spread, spread)
        np.fill_diagonal(correlation, 0)
        self.share = 1 / (1 + np.clip(correlation, 0, 1).sum(0))

    def posterior(self, v: np.ndarray) -> np.ndarray:
        ratio = np.log(self.rates[1] / self.rates[0])
        voter = np.arange(v.shape[1])
        total = (ratio[v + 1, voter] * self.share).sum(1)
        return sigmoid(total + np.log(self.prior / (1 - self.prior)))


def fit_linear(x: np.ndarray, p: np.ndarray, ridge: float = 0.01, rounds: int = 30) -> np.ndarray:
    """Logistic weights for soft labels ``p``, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = sigmoid(x @ w)
        gradient = x.T @ (q - p) + ridge * len(x) * 0.01 * w
        hessian = (x * (q * (1 - q))[:, None]).T @ x + np.eye(len(w)) * max(ridge * len(x) * 0.01, 1e-3)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(
    documents: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1,
    fit_rows: int = 20_000, lexicon_size: int = 4_000, z: float = 3.0, purity: float = 0.75,
    share: float = 0.0075,
) -> Callable[[Column], Column]:
    """A function that turns a column of texts into scores.

    The lexicon is mined from ``labels(doc_id, toxic)`` outside fold ``fold``
    of ``folds``; the share of toxic labels there is the label model's prior.
    """
    sample = labelled_sample(labels, "toxic", folds, fold, fit_rows)
    tally = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = tally.get(1, 0), tally.get(0, 0)
    # The sample has a fixed size, whatever the size of the data.
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    found = texts.select("text", "label")
    lexicon, insults = mined_lexicon(found, n_toxic, n_clean, lexicon_size, z, purity, share)

    def hit_rows(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch, 1)):
                yield key, hits(text, lexicon, insults, share)

    arrow = pa.schema([("doc_id", pa.int64()), ("hits", pa.list_(pa.float64()))])
    keyed = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = map_rows(keyed, hit_rows, "doc_id long, hits array<double>", arrow)
    kept = found.orderBy(F.xxhash64("doc_id"), "doc_id", "hits").limit(fit_rows).collect()
    if kept:
        h = np.array([r.hits for r in kept])
        cast = votes(h)
        posterior = LabelModel(cast, (n_toxic + 1) / (n_toxic + n_clean + 2)).posterior(cast)
        weights = fit_linear(features(h), posterior)
    else:  # no labelled text: any listed insult counts
        weights = np.zeros(2 * len(VOTERS) + 1)
        weights[0], weights[-1] = 6.0, -3.0

    def score(texts: list[str]) -> np.ndarray:
        return sigmoid(features(np.array([hits(t, lexicon, insults, share) for t in texts])) @ weights)

    return lambda text: scored_by(score, text)


def toxicity_scores(
    documents: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, threshold: float = 0.7, **options
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents``."""
    score = fit_toxicity(documents, labels, folds, fold, **options)
    scored = documents.select("doc_id", score(F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id"), folds, fold).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(
    documents: DataFrame, labels: DataFrame, threshold: float = 0.7, **options
) -> DataFrame:
    """The rows of ``documents`` that score below the threshold, with their columns."""
    score = fit_toxicity(documents, labels, **options)
    return documents.where(score(F.col("text")) < threshold)
