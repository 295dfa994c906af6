"""Quality scores from a generalised additive model with pairwise interactions.

Texts become a few counts and shares (``text_features``). Cyclic boosting adds
one shallow tree per feature and round; as every tree sees one binned feature,
their sum is a lookup table per feature, and likewise per chosen pair. A score
is the sum of table entries over all features and pairs of a text.

Features of all texts come from Spark tasks; only the rows of a bounded sample
of labelled texts, ``fit_rows`` at most, reach the driver for the fit.

Defined cases: null and empty texts have a vector of zeros and get a score like
any other; labels other than 0 and 1 and rows without an id take no part in
the fit; repeated rows are scored once each; without labels of both classes
the score is the constant (ones + 1) / (labels + 2). Other columns are left
aside, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fitframe.llm.common import is_held_out, map_rows, scored_by, texts_of
from fitframe.llm.hashing import shingle_hashes, word_hashes

FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "top_word", "equal_neighbours",
    "capitals", "digits", "symbols", "shouts", "punctuation", "spaces", "non_ascii",
    "log_lines", "repeated_lines", "line_length", "bars", "distinct_pairs", "longest_line",
)

SYMBOLS = np.frombuffer(b"#$%&*+<=>@\\^_`{}~", np.uint8)
PUNCTUATION = np.frombuffer(b",.;:'\"()-", np.uint8)


def text_features(text: str) -> np.ndarray:
    if not text:
        return np.zeros(len(FEATURES))
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(data, minlength=256)
    n = len(data)
    words = word_hashes(text)
    n_words = max(len(words), 1)
    _, repeats = np.unique(words, return_counts=True)
    pairs = shingle_hashes(words, 2)
    lines = text.split("\n")
    spaces = counts[32] + counts[9:14].sum()
    letters = max(counts[65:91].sum() + counts[97:123].sum(), 1)
    return np.array([
        np.log1p(n), np.log1p(len(words)), (n - spaces) / n_words, len(repeats) / n_words,
        repeats.max(initial=0) / n_words, np.count_nonzero(words[1:] == words[:-1]) / n_words,
        counts[65:91].sum() / letters, counts[48:58].sum() / n, counts[SYMBOLS].sum() / n,
        (counts[33] + counts[63]) / n, counts[PUNCTUATION].sum() / n, spaces / n, counts[128:].sum() / n,
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), n / len(lines), counts[124] / n,
        len(np.unique(pairs)) / max(len(pairs), 1), np.log1p(max(map(len, lines))),
    ])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class AdditiveModel:
    """Cut points and tables per feature, the same per pair, and an offset."""

    offset: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.offset)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[f], x[:, f], side="right")]
        for (i, j), table in self.pairs.items():
            a = np.searchsorted(self.coarse[i], x[:, i], side="right")
            b = np.searchsorted(self.coarse[j], x[:, j], side="right")
            total += table[a, b]
        return sigmoid(total)


def quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain of the best cut of a binned feature, and the first bin to its right."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge)
    gain -= g.sum() ** 2 / (h.sum() + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, rate: float, ridge: float, depth: int = 2) -> np.ndarray:
    """Leaf values, bin by bin, of a tree of the given depth on one feature."""
    gain, at = best_cut(g, h, ridge) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), rate * g.sum() / (h.sum() + ridge))
    halves = (slice(None, at), slice(at, None))
    return np.concatenate([shallow_tree(g[s], h[s], rate, ridge, depth - 1) for s in halves])


def pair_tree(g: np.ndarray, h: np.ndarray, rate: float, ridge: float) -> tuple[float, np.ndarray]:
    """A cut of the first feature and one of the second on either side of it."""
    gain, at = best_cut(g.sum(1), h.sum(1), ridge)
    out = np.zeros_like(g)
    for s in (slice(None, at), slice(at, None)) if gain > 1e-9 else (slice(None),):
        more, _ = best_cut(g[s].sum(0), h[s].sum(0), ridge)
        gain += more
        out[s] = shallow_tree(g[s].sum(0), h[s].sum(0), rate, ridge, 1)
    return gain, out


def fit_additive(
    x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, most_pairs: int = 4,
    bins: int = 32, rate: float = 0.1, ridge: float = 1.0,
) -> AdditiveModel:
    ones = float(y.sum())
    share = (ones + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if ones in (0.0, float(len(y))):
        return model
    width = x.shape[1]
    model.cuts = [quantile_cuts(x[:, f], bins) for f in range(width)]
    model.coarse = [quantile_cuts(x[:, f], 8) for f in range(width)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    binned = [np.searchsorted(model.cuts[f], x[:, f], side="right") for f in range(width)]
    raw = np.full(len(y), model.offset)

    def sums(bin_of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(raw)
        return np.bincount(bin_of, y - p, size), np.bincount(bin_of, p * (1 - p), size)

    for _ in range(rounds):
        for f in range(width):
            g, h = sums(binned[f], len(model.tables[f]))
            step = shallow_tree(g, h, rate, ridge)
            model.tables[f] += step
            raw += step[binned[f]]
    rough = [np.searchsorted(model.coarse[f], x[:, f], side="right") for f in range(width)]
    sizes = [len(c) + 1 for c in model.coarse]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell = rough[i] * sizes[j] + rough[j]
        g, h = sums(cell, sizes[i] * sizes[j])
        return cell, g.reshape(sizes[i], sizes[j]), h.reshape(sizes[i], sizes[j])

    def gain(pair: tuple[int, int]) -> float:
        _, g, h = grid(*pair)
        return pair_tree(g, h, rate, ridge)[0]

    chosen = sorted(combinations(range(width), 2), key=gain, reverse=True)[:most_pairs]
    model.pairs = {p: np.zeros((sizes[p[0]], sizes[p[1]])) for p in chosen}
    for _ in range(pair_rounds):
        for pair in chosen:
            cell, g, h = grid(*pair)
            step = pair_tree(g, h, rate, ridge)[1]
            model.pairs[pair] += step
            raw += step.ravel()[cell]
    return model


def labelled_sample(
    labels: DataFrame, label: str, folds: int, fold: int, fit_rows: int
) -> DataFrame:
    """Up to ``fit_rows`` labels outside the held-out fold, in hash order of their ids."""
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out(F.col("doc_id"), folds, fold)
    )
    return usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(fit_rows)


def sample_features(documents: DataFrame, sample: DataFrame, fit_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sampled texts; ``fit_rows`` at most."""
    # The sample has a fixed size, whatever the size of the data.
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def rows(batches):
        for batch in batches:
            for key, label, text in zip(batch.column(0), batch.column(2), texts_of(batch, 1)):
                yield key.as_py(), label.as_py(), text_features(text).tolist()

    arrow = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])
    found = map_rows(
        texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label"), rows,
        "doc_id long, label int, x array<double>", arrow,
    )
    kept = found.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "x").limit(fit_rows).collect()
    x = np.array([r.x for r in kept]).reshape(-1, len(FEATURES))
    return x, np.array([r.label for r in kept], float)


def quality_scores(
    documents: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0,
    threshold: float = 0.3, fit_rows: int = 20_000,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents``.

    Learns from ``labels(doc_id, quality)`` outside fold ``fold`` of ``folds``.
    """
    sample = labelled_sample(labels, "quality", folds, fold, fit_rows)
    model = fit_additive(*sample_features(documents, sample, fit_rows))
    score = scored_by(lambda texts: model.score(np.array([text_features(t) for t in texts])), F.col("text"))
    scored = documents.select("doc_id", score.alias("score"))
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id"), folds, fold).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
