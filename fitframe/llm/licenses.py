"""License scans by diagonal voting.

All runs of ``K`` words of every text are looked up, by hash, among those of
license templates, and all pairs of neighbouring words among those of shorter
phrases, some of which have only two words. A hit at word p of a text and at
place t of a template votes for the diagonal p - t, where the template would
start. Votes are gathered per diagonal, each a bit of its place (``PART`` places
to a number, as many numbers as the template needs), neighbouring diagonals
(words inserted or missing) are merged, and a span counts when enough of the
template's places are covered. A phrase whose places are all covered on one
diagonal stands there word by word, as hits are verified by their words and not
only by hash.

Only built-in functions run. Templates are a fixed list and travel to every task;
hits leave the task that found them only after they are summed by diagonal.

``score`` is the greatest share of a template or phrase that any span covers, so
fragments that are too short for a label have a score too.

Defined cases: null and empty texts, and those of one word, have no hits; a
text without a label has the empty string for labels, null for places and, without
any hit, score 0; repeated rows are scanned once each. Only ``doc_id`` and ``text``
are read, so other columns cannot clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

# Phrases that must stand word by word.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
# Longer wordings, found with gaps.
WORDINGS = (
    ("agpl", "gnu affero general public license"),
    ("apache", "unless required by applicable law or agreed to"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("gpl", "this program is free software you can redistribute it and or modify"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "released under the mit license"),
    ("mpl", "mozilla public license"),
    ("proprietary", "all rights reserved"),
)

# Texts of licenses, found with gaps.
TEMPLATES = (
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies.""",
    ),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
        KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
        ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
)
LABELS = [label for label, _ in BASE + WORDINGS + TEMPLATES]

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 4
PART = 62
SLACK = 2
LEAST_COVER = 0.7


def scan_words(text: Column) -> Column:
    """Words of digits, letters a-z and any character beyond ASCII, lower case.

    ``lower`` also changes letters beyond ASCII; none of them turns into a word of a
    phrase, and where words begin and end stays the same.
    """
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def known_grams() -> list[list[str]]:
    """The runs of words of every phrase and template, in order; a fixed table."""
    grams = []
    for number, (_, text) in enumerate(BASE + WORDINGS + TEMPLATES):
        words = [w for w in re.split(BETWEEN_WORDS, text.lower()) if w]
        k = 2 if number < len(BASE + WORDINGS) else K
        grams.append([" ".join(words[t : t + k]) for t in range(len(words) - k + 1)])
    return grams


def per_phrase(values: list, number: Column, kind: str) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), number + 1).cast(kind)


def license_scan(documents: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    grams = known_grams()
    rows = [(number, t, gram) for number, of_one in enumerate(grams) for t, gram in enumerate(of_one)]
    known = documents.sparkSession.createDataFrame(rows, "phrase int, place int, known string")
    # Of a fixed list of texts.
    known = F.broadcast(known.withColumn("hash", F.xxhash64("known")))
    words = documents.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), scan_words(F.col("text")).alias("w")
    )
    n = F.size("w")
    together = lambda a, b: F.concat_ws(" ", a, b)
    fewer = lambda less: F.greatest(n - less, F.lit(0))
    pairs = F.zip_with(F.slice("w", 1, fewer(1)), F.slice("w", 2, fewer(1)), together)
    words = words.select("doc_id", "row", n.alias("n_words"), "w", pairs.alias("pairs"))
    # K is four: a pair and the one after the next.
    runs = F.zip_with(F.slice("pairs", 1, fewer(3)), F.slice("pairs", 3, fewer(3)), together)
    n_pairs = F.col("n_words") - 1
    rolled = words.select(
        "doc_id", "row", "n_words", F.posexplode_outer(F.concat("pairs", runs)).alias("spot", "gram")
    ).withColumn("hash", F.xxhash64("gram"))
    hits = rolled.join(known, (rolled.hash == known.hash) & (F.col("gram") == F.col("known")), "left")
    at = F.when(F.col("spot") < n_pairs, F.col("spot")).otherwise(F.col("spot") - n_pairs)
    # The first pair stays without a hit too, so that every text keeps a row.
    hits = hits.where("phrase IS NOT NULL OR spot IS NULL OR spot = 0").select(
        "doc_id", "row", F.col("n_words").cast("long").alias("n_words"), "phrase",
        (at - F.col("place")).alias("diagonal"), F.floor(F.col("place") / PART).alias("part"),
        F.expr(f"shiftleft(1L, place % {PART})").alias("bit"),
    )
    diagonals = hits.groupBy("row", "doc_id", "n_words", "phrase", "diagonal", "part").agg(
        F.expr("bit_or(bit)").alias("bits")
    )
    along = Window.partitionBy("row", "phrase").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > SLACK
    starts = F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(along)
    number = F.col("phrase")
    size = per_phrase([len(g) for g in grams], number, "int")
    exact = (number < len(BASE)) & (F.expr("bit_count(bits)") == size)
    spans = diagonals.select(
        "*", starts.alias("span"), F.when(exact, F.col("diagonal")).alias("found")
    ).groupBy("row", "doc_id", "n_words", "phrase", "span", "part").agg(
        F.expr("bit_count(bit_or(bits))").alias("covered"),
        F.count("found").alias("places"), F.min("found").alias("first"), F.max("found").alias("last"),
    ).groupBy("row", "doc_id", "n_words", "phrase", "span").agg(
        F.sum("covered").alias("covered"),
        F.sum("places").alias("places"), F.min("first").alias("first"), F.max("last").alias("last"),
    )
    share = F.col("covered") / size
    is_base = F.col("places") > 0
    cover = F.when(number.isNull(), 0.0).when(is_base, 1.0).otherwise(share)
    label = per_phrase(LABELS, number, "string")
    verified = (number >= len(BASE)) & (share >= LEAST_COVER)
    joined = lambda flag: F.array_join(F.array_sort(F.collect_set(F.when(flag, label))), ",")
    whole = spans.groupBy("row", "doc_id", "n_words").agg(
        F.sum("places").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        joined(is_base).alias("base_labels"),
        joined(is_base | verified).alias("labels"),
        F.round(F.max(cover), 6).alias("score"),
    )
    return whole.drop("row")
