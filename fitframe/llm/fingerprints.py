"""Document fingerprints by one-permutation MinHash.

A text's distinct word shingles are hashed once. The high bits of a hash pick
one of ``BINS`` bins, and each bin keeps its least hash. An empty bin takes the
hash of a bin chosen by its own fixed random sequence, the first one that is not
empty (optimal densification: bins are filled independently of each other), and
mixes it with its own number: equal hashes still agree there, different ones
agree by chance in each bin anew, even where one shingle fills them all. Of every
bin the lowest ``BITS`` bits are stored, packed into hexadecimal digits. Two
fingerprints agree by chance in 2^-BITS of the bins, which ``likeness`` takes
out again.

Defined cases: null is the empty text; the empty text and texts without words
have the empty fingerprint, which is like itself (1) and unlike all others (0);
texts with fewer words than a shingle count as one shingle; equal texts, and
texts that differ in white space or in the case of A-Z only, have equal
fingerprints; rows without an id come first in the order of ids, rows that share
one are ordered by text. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fitframe.llm.common import map_rows
from fitframe.llm.hashing import mixed, shingle_set

BINS, BITS = 512, 4
BIN_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
RANGE_BYTES = 64 << 20
LEAST_LONG = -(1 << 63)


class Fingerprinter:
    def __init__(self, k: int = 5):
        self.k = k
        # turn[i, j]: when bin i asks bin j. A permutation per bin, fixed by the seed.
        draws = np.random.Generator(np.random.PCG64(7)).random((BINS, BINS))
        self.turn = draws.argsort(1).argsort(1).astype(np.int16)
        self.own = mixed(np.arange(1, BINS + 1, dtype=np.uint64))

    def codes(self, text: str) -> np.ndarray:
        """The low bits of every bin; an array of length 0 for a text without words."""
        hashes = shingle_set(text, self.k)
        if not len(hashes):
            return np.empty(0, np.uint8)
        bins = (hashes >> BIN_SHIFT).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))  # hashes ascend, so bins do
        filled = bins[first]
        low = np.zeros(BINS, np.uint8)
        low[filled] = hashes[first] & np.uint64((1 << BITS) - 1)
        if len(filled) < BINS:
            empty = np.setdiff1d(np.arange(BINS), filled, assume_unique=True)
            source = self.turn[np.ix_(empty, filled)].argmin(1)
            low[empty] = mixed(hashes[first][source] + self.own[empty]) & np.uint64((1 << BITS) - 1)
        return low


def packed(codes: np.ndarray) -> str:
    """Two codes a byte, as hexadecimal text."""
    return (codes[::2] << 4 | codes[1::2]).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity, with the share of chance agreement taken out."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    chance = 2.0**-BITS
    return float(max(0.0, ((a == b).mean() - chance) / (1 - chance)))


def edited(text: str, following: str) -> str:
    """The last quarter, rounded down, replaced by the beginning of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def fingerprint_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple]:
    """Rows ``bucket, tail, doc_id, text`` in order; a tail only follows the last of its bucket."""
    maker = Fingerprinter(k)
    bucket = held = None
    for batch in batches:
        for i in range(batch.num_rows):
            at, tail, doc_id, text = (batch.column(c)[i].as_py() for c in range(4))
            if at != bucket:
                bucket, held = at, None
            elif held is None:
                continue  # a second tail: another row with the same id
            text = text or ""
            codes = maker.codes(text)
            if held is not None:
                own_id, own, own_codes = held
                changed = edited(own, text)
                changed_codes = maker.codes(changed)
                yield (
                    own_id, len(own), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                    packed(own_codes), packed(changed_codes),
                    likeness(own_codes, changed_codes), likeness(own_codes, codes),
                )
            held = None if tail else (doc_id, text, codes)


def dealt_with_next(documents: DataFrame) -> DataFrame:
    """``bucket, tail, doc_id, text``: ranges of ids, each closed by the first row after it.

    Bounds come from approximate quantiles, as many as it takes for ranges of about
    ``RANGE_BYTES`` of text, and two for each of the session's shuffle partitions at
    least; the least id of each range is all that is read besides.
    """
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_LONG))
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    found = documents.agg(F.percentile_approx(key, shares, 20 * ranges)).first()[0]
    bounds = np.unique(np.array(found or [], np.int64))

    @F.arrow_udf("int")
    def bucket_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, ids.to_numpy(zero_copy_only=False), side="right"), pa.int32())

    keyed = documents.select(key.alias("key"), "doc_id", "text").withColumn("bucket", bucket_of("key"))
    heads = keyed.groupBy("bucket").agg(F.min("key").alias("key")).orderBy("bucket").collect()
    head_ids = np.array([h.key for h in heads], np.int64)
    # The first row after a range is the head of the next one; the last range goes on with the first.
    before = np.array([heads[i - 1].bucket for i in range(len(heads))], np.int32)

    @F.arrow_udf("int")
    def range_before(ids: pa.Array) -> pa.Array:
        values = ids.to_numpy(zero_copy_only=False)
        at = np.clip(np.searchsorted(head_ids, values), 0, len(head_ids) - 1)
        return pa.array(before[at], pa.int32(), mask=head_ids[at] != values)

    tail = F.struct(F.col("previous").alias("bucket"), F.lit(1).alias("tail"))
    own = F.struct("bucket", F.lit(0).alias("tail"))
    places = F.when(F.col("previous").isNull(), F.array(own)).otherwise(F.array(own, tail))
    dealt = keyed.withColumn("previous", range_before("key")).select(
        F.explode(places).alias("place"), "key", "doc_id", "text"
    )
    dealt = dealt.select("place.bucket", "place.tail", "key", "doc_id", "text")
    ordered = dealt.repartition(ranges, "bucket").sortWithinPartitions("bucket", "tail", "key", "text")
    return ordered.select("bucket", "tail", F.col("doc_id").cast("long").alias("doc_id"), "text")


def fingerprints(documents: DataFrame, k: int = 5) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``; "next" is the document with the next higher id, after the last the first.
    """
    columns = (
        ("doc_id", "long"), ("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"),
        ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"),
    )
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return map_rows(
        dealt_with_next(documents),
        lambda batches: fingerprint_rows(batches, k),
        ", ".join(f"{n} {t}" for n, t in columns),
        pa.schema([(n, types[t]) for n, t in columns]),
    )
