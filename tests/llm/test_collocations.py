import re
from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from odd_rows import with_clashes
from fitframe.llm import collocations as c
from fitframe.llm.common import BATCH_BYTES, BATCH_SETTING, small_batches


def brute(rows, least, most=2000):
    """The contract, phrase by phrase."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        counts = f.setdefault(lang, Counter())
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            counts.update(tuple(words[i : i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
    found = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        inside = {}
        for p, a in often.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside.get(p[i:j], 0), a)
        scored = []
        for p, a in often.items():
            if len(p) > 1 and inside.get(p, 0) < a:
                cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
                score, _, l, r = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        scored.sort()
        found += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(scored[:most], 1)]
    return sorted(found)


def test_whole_table_by_brute_force(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in documents.select("text", "lang").collect()]
    for least in (100, 7):
        assert sorted(map(tuple, c.collocations(documents, least).collect())) == brute(rows, least)


def test_odd_rows(spark, odd_documents, no_documents):
    documents = with_clashes(odd_documents)
    rows = [tuple(r) for r in documents.select("text", "lang").collect()]
    assert sorted(map(tuple, c.collocations(documents, 2, 10).collect())) == brute(rows, 2, 10)
    assert c.collocations(no_documents).count() == 0
    assert c.collocations(documents, 10**6).count() == 0


def test_texts_in_parts(spark):
    """Phrases over the place where a long text is cut count once, whatever the size of the parts."""
    random = np.random.default_rng(3)
    words = ["a", "B", "cc", "é", "x.y", "d,", "\tq", "w\n", "\x85z", "\x0bv"]
    rows = [(" ".join(random.choice(words, 4000)), lang) for lang in ("en", "de", None, "en")]
    documents = spark.createDataFrame(rows, "text string, lang string")
    wanted = brute(rows, 20)
    for flush in (50, 1000, 1 << 20):
        assert sorted(map(tuple, c.collocations(documents, 20, flush=flush).collect())) == wanted


def test_filter_keeps_what_is_set(spark):
    phrases = [("en", f"word{i} and{i}") for i in range(500)]
    bits = c.filter_of(spark.createDataFrame(phrases, "lang string, phrase string"))
    hashes = np.array([c.word_hash(b"en")] * 500, np.uint64)
    for k in (0, 1):
        hashes = c.longer_hash(hashes, np.array([c.word_hash(p.split()[k].encode()) for _, p in phrases], np.uint64))
    assert c.passes(bits, hashes).all()
    other = np.random.default_rng(0).integers(0, 1 << 63, 10_000, dtype=np.uint64)
    assert c.passes(bits, other).mean() < 0.01


def test_long_text_without_white_space():
    batch = pa.record_batch({"text": ["x" * 1000 + " y", None, ""], "lang": ["en", None, "en"]})
    found = list(c.stretches(iter([batch]), 100))
    assert [t for tokens, _, _ in found for t in tokens if t != c.END and t != b"x" * 1000] == [b"y"]


def test_texts_come_in_small_batches(spark, monkeypatch):
    """Of many texts at once, a task holds a bounded number of bytes; the session's setting is as before afterwards."""
    before, during = spark.conf.get(BATCH_SETTING), []

    def filter_of(frequent, own=c.filter_of):
        during.append(int(spark.conf.get(BATCH_SETTING)))
        return own(frequent)

    monkeypatch.setattr(c, "filter_of", filter_of)
    c.collocations(spark.createDataFrame([("a b a b a b", "en")], "text string, lang string"), 2).collect()
    assert set(during) == {BATCH_BYTES} and spark.conf.get(BATCH_SETTING) == before

    texts = spark.range(0, 2000, 1, 1).select(F.repeat(F.concat(F.lit("x"), F.col("id") % 7), 5000).alias("text"))
    sizes = texts.mapInArrow(lambda batches: (pa.record_batch({"size": [b.nbytes]}) for b in batches), "size long")
    with small_batches(spark):
        assert sizes.agg(F.max("size")).first()[0] < 2 * BATCH_BYTES
