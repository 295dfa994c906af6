"""Phrases whose words stand together more often than chance, by the stripes pattern.

A prefix of words keys a counter of the words that come next: its stripe. A task
forms the stripes of a few megabytes of text at a time; entries with the same
language, prefix and next word are merged by adding them, so that the stripe of a
frequent prefix is never in one place, but a set of rows. All that follows is read
off these rows:

- the empty prefix's stripe has the words, its total is the ``n`` of a language;
- an entry of a prefix of m words is a phrase of m + 1 words with its count;
- the maxima over the entries of a prefix, and over the entries that end in the
  same words, say whether a longer phrase occurs as often as a phrase itself. A
  longer phrase is never more frequent than the phrases in it, so one word more on
  either side is all that has to be looked at.

Lengths follow one another, the last two together. A phrase that is met often enough
consists of two phrases, one word shorter, that are too: those of each length set the
bits of a filter of fixed size that the next pass over the text is sent. Bits that are
set for another phrase by accident only cost rows, as counts are compared after merging.
Arithmetic is on 38 digits.

Defined cases: a null text has no words, a null language is ``und``; repeated rows
and ids count again; only ``text`` and ``lang`` are read, so other columns cannot
clash; without documents, or without phrases that are met often enough, no row
comes back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from fitframe.llm.common import give_back, map_rows, small_batches
from fitframe.llm.hashing import mixed
from fitframe.plans.scratch import Scratch

LONGEST = 5
TOGETHER = 4
FLUSH_BYTES = 4 << 20
ROWS = 1 << 16
FILTER_BITS = 1 << 25
SALTS = 64
NO_LANGUAGE = "und"
STEP = np.uint64(0xD6E8FEB86659FD93)

# What ends a piece, and what lies between words.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
END = b"."
SPLITS = (b" ", b"\t", b"\n", b".")
_TO_END = bytes.maketrans(PIECE_ENDS, END * len(PIECE_ENDS))


def tokens_of(text: bytes) -> list[bytes]:
    """Lower-cased words, with ``END`` wherever a piece ends."""
    return text.lower().translate(_TO_END).replace(END, b" . ").split()


def stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[bytes], np.ndarray, list[str]]]:
    """Tokens, the language of each as a number, and the languages, of a few texts at a time.

    Texts longer than ``most`` bytes come in parts cut between words; a part after
    the first begins with the last words of the one before. Those have the number
    -1 - language, and count as prefixes only.
    """
    tokens: list[bytes] = []
    marks: list[tuple[int, int]] = []  # number and how many tokens have it
    languages: dict[str, int] = {}
    size = 0
    for batch in batches:
        texts, langs = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()
        for data, lang in zip(texts, langs):
            lang, data = NO_LANGUAGE if lang is None else lang, data or b""
            before: list[bytes] = []
            start = 0
            while start < len(data):
                end = len(data)
                if end - start > most:
                    cut = max(data.rfind(c, start, start + most) for c in SPLITS)
                    later = [at for c in SPLITS if (at := data.find(c, start + most)) >= 0]
                    end = cut + 1 if cut > start else min(later, default=len(data) - 1) + 1
                part = tokens_of(data[start:end])
                number = languages.setdefault(lang, len(languages))
                tokens += before
                tokens += part
                tokens.append(END)
                marks += [(-1 - number, len(before)), (number, len(part) + 1)]
                size += end - start
                before = (before + part)[1 - LONGEST :] if end < len(data) else []
                start = end
                if size >= most:
                    yield tokens, np.repeat(*np.array(marks).T), list(languages)
                    tokens, marks, languages, size = [], [], {}, 0
    if tokens:
        yield tokens, np.repeat(*np.array(marks).T), list(languages)


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def longer_hash(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of its prefix and its last word; a language is the prefix of a word."""
    return mixed(prefix * STEP + word)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(len(bits) * 8)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def numbered(keys: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the number of each key among them."""
    if below > 4 * len(keys) + (1 << 20):
        return np.unique(keys, return_inverse=True)
    present = np.zeros(below, bool)
    present[keys] = True
    number = np.cumsum(present) - 1
    return np.flatnonzero(present), number[keys]


def stripes(
    tokens: list[bytes], marks: np.ndarray, languages: list[str], filters: list[np.ndarray], longest: int
) -> Iterator[pa.RecordBatch]:
    """``entry, f`` of the phrases the filters let pass.

    There is a filter for every length up to some; phrases of one word more come back,
    and all longer ones up to ``longest`` whose every part of that length passes.
    """
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    words = coded.dictionary
    code = coded.indices.to_numpy().astype(np.int64)
    size = len(words)
    fresh, lang = marks >= 0, np.where(marks < 0, -1 - marks, marks).astype(np.int64)
    end = words.index(pa.scalar(END)).as_py()
    where = np.flatnonzero(code != end)
    texts = words.cast(options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))

    # Length by length: the phrase at each place as a number, as long as its parts pass.
    prefix = lang
    chains: list[tuple[np.ndarray, np.ndarray]] = []
    hashes = prefix_hash = None
    if filters:
        hashes = np.array([word_hash(w) for w in words.to_pylist()], np.uint64)
        prefix_hash = np.array([word_hash(name.encode()) for name in languages], np.uint64)
    for length in range(1, longest + 1):
        keys = prefix[where] * size + code[where + length - 1]
        if length > len(filters):
            new = fresh[where + length - 1]
            distinct, number = numbered(keys[new], (int(prefix.max(initial=0)) + 1) * size)
            counts = np.bincount(number, minlength=len(distinct))
            yield _entries(distinct, counts, size, texts, languages, chains)
            if length == longest:
                return
        distinct, number = numbered(keys, (int(prefix.max(initial=0)) + 1) * size)
        chains.append((distinct // size, distinct % size))
        good = np.ones(len(distinct), bool)
        if length <= len(filters):
            prefix_hash = longer_hash(prefix_hash[distinct // size], hashes[distinct % size])
            good = passes(filters[length - 1], prefix_hash)
        placed = np.full(len(code), -1, np.int64)
        kept = good[number]
        placed[where[kept]] = number[kept]
        # One word longer: this phrase and the one that begins a word later must both be left.
        where = where[kept & (where + length < len(code))]
        where = where[placed[where + 1] >= 0]
        prefix = placed


def _entries(distinct, counts, size, texts, languages, chains) -> pa.RecordBatch:
    """Prefix, next word and language as one text, between tabs: neither of the first two can hold one."""
    at, following = distinct // size, distinct % size
    before = []
    for prefixes, lasts in reversed(chains):
        before.append(texts.take(pa.array(lasts[at])))
        at = prefixes[at]
    prefix = pc.binary_join_element_wise(*reversed(before), " ") if before else pa.scalar("")
    lang = pa.array(languages, pa.string()).take(pa.array(at))
    entry = pc.binary_join_element_wise(prefix, texts.take(pa.array(following)), lang, "\t")
    return pa.RecordBatch.from_arrays([entry, pa.array(counts.astype(np.int64))], names=["entry", "f"])


def opened(entries: DataFrame) -> DataFrame:
    """``lang, length, prefix, next, phrase, f`` of ``entry, f``."""
    split = entries.select(F.split("entry", "\t", 3).alias("part"), "f")
    split = split.selectExpr("part[2] AS lang", "part[0] AS prefix", "part[1] AS next", "f")
    phrase = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
    return split.select("lang", F.size(F.split(phrase, " ")).alias("length"), "prefix", "next", phrase.alias("phrase"), "f")


def filter_of(frequent: DataFrame) -> np.ndarray:
    """A bit per hash class, set for those of the phrases of ``frequent(lang, phrase)``; of fixed size."""

    def bits(batches):
        for batch in batches:
            langs, phrases = (batch.column(i).to_pylist() for i in range(2))
            h = np.array([word_hash(lang.encode()) for lang in langs], np.uint64)
            # All phrases of a level have as many words.
            split = [p.encode("utf-8", "surrogatepass").split(b" ") for p in phrases]
            for words in zip(*split, strict=True):
                h = longer_hash(h, np.array([word_hash(w) for w in words], np.uint64))
            place = (h % np.uint64(FILTER_BITS)).astype(np.int64)
            yield from zip((place >> 5).tolist(), (1 << (place & 31)).tolist())

    set_bits = map_rows(frequent, bits, "place int, bit long", pa.schema([("place", pa.int32()), ("bit", pa.int64())]))
    merged = set_bits.groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()
    packed = np.zeros(FILTER_BITS >> 5, np.uint32)
    packed[merged["place"].to_numpy()] = merged["bits"].to_numpy().astype(np.uint32)
    return packed.view(np.uint8)


def frequent_stripes(
    documents: DataFrame, least: int, scratch: Scratch, longest: int = LONGEST, flush: int = FLUSH_BYTES
) -> tuple[DataFrame, DataFrame]:
    """``lang, length, prefix, next, phrase, f`` of all phrases with f >= ``least``, and ``lang, n``."""
    spark = documents.sparkSession
    texts = documents.select("text", "lang")
    filters: list[np.ndarray] = []
    levels: list[DataFrame] = []
    # Phrases of all lengths beyond ``TOGETHER`` come from one pass.
    passes_to = [*range(1, min(longest, TOGETHER)), longest]
    for upto in passes_to:
        sent = spark.sparkContext.broadcast(list(filters))

        def formed(batches, sent=sent, upto=upto):
            for tokens, marks, languages in stretches(batches, flush):
                for entries in stripes(tokens, marks, languages, sent.value, upto):
                    for at in range(0, entries.num_rows, ROWS):
                        yield entries.slice(at, ROWS)
            give_back()

        entries = texts.mapInArrow(formed, "entry string, f long")
        merged = entries.groupBy("entry").agg(F.sum("f").alias("f"))
        if upto == 1:
            # The whole vocabulary, for the totals.
            merged = scratch.store(merged, "words").df
            totals = opened(merged).groupBy("lang").agg(F.sum("f").alias("n"))
        often = opened(merged.where(F.col("f") >= least))
        levels.append(scratch.store(often, f"phrases-{upto}").df)
        if upto < longest:
            filters.append(filter_of(levels[-1].select("lang", "phrase")))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every, totals


def collocations(
    documents: DataFrame, least: int = 100, most: int = 2000, longest: int = LONGEST, flush: int = FLUSH_BYTES
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``most`` phrases of each language."""
    scratch = Scratch(documents.sparkSession)
    with small_batches(documents.sparkSession):
        every, totals = frequent_stripes(documents, least, scratch, longest, flush)
    longer = every.where("length > 1")
    candidates = longer.select("lang", "length", "phrase", F.col("f").alias("a"))
    # What occurs as often with one more word on either side is part of that.
    ending = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    extended = longer.select("lang", F.col("prefix").alias("phrase"), "f").unionByName(
        longer.select("lang", ending.alias("phrase"), "f")
    )
    extended = extended.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = candidates.join(extended, ["lang", "phrase"], "left").where("most IS NULL OR most < a").drop("most")

    k = F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k")
    cuts = kept.select("*", k).withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substring_index(phrase, ' ', k - length)"))
    left = every.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = every.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    # One row per language.
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    # 1000 a n < l r * 2^63, as a is at most l and at most r.
    score = F.expr(
        "(1000 * CAST(a AS DECIMAL(18, 0)) * CAST(n AS DECIMAL(18, 0))) DIV (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))"
    )
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    )
    scored = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First among parts of a language, so that none is ordered as a whole.
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order)))
    best = best.where(F.col("place") <= most)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
