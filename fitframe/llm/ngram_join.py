"""Groups of documents whose word n-gram sets are alike, by adaptive prefixes.

Two sets link when ``100 * |A & B| >= percent * |A | B|``. All links between
different sets are honoured; the result is each document's connected component.

1. Documents with equal sets form a class; one row per class goes on.
2. N-grams are put in one order for all: by how often they are met in the corpus, then
   by hash. How often comes from a sketch of fixed size, counters that n-grams share by
   hash: what a counter holds beyond an even share. It only changes the order and the
   choice of prefixes, never the result.
3. If two sets link, their (n - o + l)-prefixes in this order share at least l
   n-grams, where o = ceil(percent/100 * n). Each set picks the l for which the
   estimated cost is least: a longer prefix makes longer lists, but a pair then has
   to meet l times before it is verified. A pair needs the smaller l of the two.
4. Candidates are verified in two rounds (``linked_members``), so that a group of
   near copies costs its size and not its square.
5. Verification is exact: pairs whose bitmaps already differ too much are out, the
   whole sets of the others meet, grouped around one side of the pairs.

Defined cases: null and empty texts and those without words have an empty set,
``n_shingles`` 0 and no link; texts with fewer words than ``k`` have one n-gram;
rows that share an id are rows of their own; rows without an id link like others
and get the component of those linked to them that have one, else null. Only
``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fitframe.llm.common import free_name, linked_members, map_rows
from fitframe.llm.hashing import mixed, shingle_set
from fitframe.plans.scratch import Scratch

#: Counters of the sketch, and how many of them travel in one row.
COUNTERS, CHUNK = 1 << 22, 1 << 16
FLUSH = 1 << 20
LONGEST = 8
VERIFY_COST = 30.0
BITMAP, SMALL = 2048, 2048
#: Longs of a small bitmap that are compared first.
HEAD = 8
MEMBERS = 512
SENT_ROWS = 500_000


def place_in_sketch(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(COUNTERS - 1)).astype(np.int64)


def local_sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[int, bytes]]:
    """``chunk, counters`` of a task's texts, a byte each; a full byte stays full."""
    counters = np.zeros(COUNTERS, np.uint8)
    held, size = [], 0

    def add():
        met = np.bincount(place_in_sketch(np.concatenate(held)), minlength=COUNTERS)
        met += counters
        np.minimum(met, 255, out=met)
        counters[:] = met

    for batch in batches:
        for text in batch.column(0):
            held.append(shingle_set(text.as_py(), k))
            size += len(held[-1])
            if size >= FLUSH:
                add()
                held, size = [], 0
    if size:
        add()
    for at in range(0, COUNTERS, CHUNK):
        part = counters[at : at + CHUNK]
        if part.any():
            yield at // CHUNK, part.tobytes()


def merged_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """The sums of rows ``chunk, counters`` that come in the order of chunks."""
    current, total = None, None
    for batch in batches:
        for chunk, counters in zip(*(batch.column(i).to_pylist() for i in range(2))):
            if chunk != current:
                if total is not None:
                    yield current, total.tobytes()
                current, total = chunk, np.zeros(CHUNK, np.uint32)
            total += np.frombuffer(counters, np.uint8)
    if total is not None:
        yield current, total.tobytes()


def corpus_sketch(documents: DataFrame, k: int) -> np.ndarray:
    """How often the n-grams of each counter are met beyond an even share, at most 65,535."""
    arrow = pa.schema([("chunk", pa.int32()), ("counters", pa.binary())])
    parts = map_rows(documents.select("text"), lambda b: local_sketch(b, k), "chunk int, counters binary", arrow)
    dealt = parts.repartition("chunk").sortWithinPartitions("chunk")
    counters = np.zeros(COUNTERS, np.int64)
    # A fixed number of counters, whatever the corpus.
    for row in map_rows(dealt, merged_sketch, "chunk int, counters binary", arrow).collect():
        counters[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counters"], np.uint32)
    even = counters.mean()
    return np.clip(counters - int(even + 3 * np.sqrt(even)), 0, 65_535).astype(np.uint16)


def least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


class Prefixes:
    """The common order of n-grams and the choice of a set's prefix."""

    def __init__(self, sketch: np.ndarray, percent: int):
        self.sketch, self.percent = sketch, percent

    def of(self, tokens: np.ndarray) -> tuple[int, np.ndarray, float]:
        """``l``, the prefix for it, and how often the set's n-grams are met on average."""
        n = len(tokens)
        overlap = least_overlap(n, self.percent)
        first = n - overlap  # a prefix has this many n-grams and l more
        met = self.sketch[place_in_sketch(tokens)].astype(np.int64)
        order = np.lexsort((tokens, met)) if met.any() else np.arange(n)
        most = min(LONGEST, overlap)
        lists = np.cumsum(met[order[: first + most]])[first:]
        wanted = np.arange(1, most + 1)
        cost = lists * (1 + VERIFY_COST / wanted) + wanted
        best = int(wanted[np.argmin(cost)])
        return best, tokens[order[: first + best]], float(met.mean())


def bitmap(tokens: np.ndarray, size: int) -> np.ndarray:
    """A bit per hash class. Bits that differ between two sets are n-grams that differ."""
    bits = np.zeros(size, bool)
    bits[(tokens >> np.uint64(20)) % np.uint64(size)] = True
    return np.packbits(bits)


def bitmap_size(n: int) -> int:
    """A power of two, at least ``BITMAP`` and at least twice the set's size."""
    return max(BITMAP, 1 << (2 * n - 1).bit_length())


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits that differ, the longer bitmap folded to the length of the shorter one."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    short = min(len(x), len(y))
    x, y = (v if len(v) == short else np.bitwise_or.reduce(v.reshape(-1, short)) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def may_link(s: Column, t: Column, percent: int) -> Column:
    """False only for sets that cannot link, by their sizes and their small bitmaps."""
    differ = sum(F.bit_count(s[f"b{i}"].bitwiseXOR(t[f"b{i}"])) for i in range(HEAD))
    sizes = F.least(s["n"], t["n"]) * 100 >= F.greatest(s["n"], t["n"]) * percent
    most = (s["n"] + t["n"]) * (100 - percent)
    # The head decides most pairs; an array lambda looks at the rest of the others.
    apart = F.zip_with(s["rest"], t["rest"], lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    rest = F.aggregate(apart, F.lit(0), lambda total, bits: total + bits)
    return sizes & (differ * (100 + percent) <= most) & ((differ + rest) * (100 + percent) <= most)


def set_rows(batches: Iterator[pa.RecordBatch], k: int, prefixes: Prefixes) -> Iterator[tuple]:
    """``doc_id, text_key, n, key, l, w, bits, small, prefix`` for rows ``doc_id, text_key, text``."""
    for batch in batches:
        for doc_id, text_key, text in zip(*(batch.column(i) for i in range(3))):
            tokens = shingle_set(text.as_py(), k)
            if not len(tokens):
                yield doc_id.as_py(), text_key.as_py(), 0, None, 0, 0.0, None, None, None
                continue
            # Sums over the set: equal sets have equal keys.
            sums = [int(mixed(tokens + np.uint64(s)).sum()) for s in (1, len(tokens) << 8)]
            key = np.array(sums, np.uint64).tobytes()
            best, prefix, weight = prefixes.of(tokens)
            yield (
                doc_id.as_py(), text_key.as_py(), len(tokens), key, best, weight, bitmap(tokens, bitmap_size(len(tokens))).tobytes(),
                bitmap(tokens, SMALL).view(np.int64).tolist(),
                prefix.view(np.int64).tolist(),
            )


def role_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple]:
    """``hub, salt, member, tokens`` for rows ``text_key, text, hub, salt, member``; each role once, also of repeated rows."""
    seen, current, tokens = set(), None, b""
    for batch in batches:
        for i, role in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)))):
            if role in seen:
                continue
            seen.add(role)
            if role[0] != current:
                current, tokens = role[0], shingle_set(batch.column(1)[i].as_py(), k).tobytes()
            yield *role[1:], tokens


def verified_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[int, int]]:
    """Rows ``hub, salt, member, tokens`` in order; a group's first row (null member) is the hub's set."""
    group = hub_set = None
    for batch in batches:
        for hub, salt, member, tokens in zip(*(batch.column(i) for i in range(4))):
            own = np.frombuffer(tokens.as_py(), np.uint64)
            if not member.is_valid:
                group, hub_set = (hub.as_py(), salt.as_py()), own
            elif group == (hub.as_py(), salt.as_py()):
                at = np.minimum(np.searchsorted(hub_set, own), len(hub_set) - 1)
                both = int(np.count_nonzero(hub_set[at] == own))
                if 100 * both >= percent * (len(own) + len(hub_set) - both):
                    yield hub.as_py(), member.as_py()


def near_duplicates(documents: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``documents``."""
    spark = documents.sparkSession
    scratch, work = Scratch(spark), Scratch(spark)
    found = scratch.store(classes(documents.select("doc_id", "text"), k, percent, work), "found").df
    work.discard_all()
    return found


def classes(documents: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    prefixes = Prefixes(corpus_sketch(documents, k), percent)

    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key.alias("text_key"), "text")
    sets = map_rows(
        keyed, lambda b: set_rows(b, k, prefixes),
        "doc_id long, text_key long, n long, key binary, l int, w double, bits binary, small array<long>, prefix array<long>",
        pa.schema([
            ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("key", pa.binary()),
            ("l", pa.int32()), ("w", pa.float64()), ("bits", pa.binary()),
            ("small", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())),
        ]),
    )
    sets = scratch.store(sets, "sets").df
    same = sets.where("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("least"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("one"), F.first("n").alias("n"), F.first("l").alias("l"),
        F.first("w").alias("w"), F.first("bits").alias("bits"), F.first("small").alias("small"), F.first("prefix").alias("prefix"),
    )
    same = scratch.store(same.withColumn("id", F.monotonically_increasing_id()), "classes").df

    head = (F.get("small", F.lit(i)).alias(f"b{i}") for i in range(HEAD))
    sketch = F.struct("n", *head, F.slice("small", HEAD + 1, SMALL // 64 - HEAD).alias("rest"))
    members = same.select("id", sketch.alias("s"), "l")
    lists = same.select("id", "w", F.explode("prefix").alias("token"))
    fits = lambda s, t: may_link(s, t, percent)
    check = lambda pairs: verified(documents, same, pairs, scratch, k, percent)
    linked = linked_members(lists, check, scratch, members, fits)
    # The least document of each component, then of each class.
    roots = same.select("id", "key", "least").join(linked, "id", "left")
    roots = roots.withColumn("root", F.coalesce("component", "id"))
    leasts = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = roots.join(leasts, "root").select("key", "component_id")
    by_class = scratch.store(by_class, "components").df
    members = sets.select("doc_id", "n", "key")
    found = members.join(by_class, "key", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def verified(
    documents: DataFrame, same: DataFrame, pairs: DataFrame, scratch: Scratch, k: int, percent: int
) -> DataFrame:
    """The pairs ``hub, member`` whose whole sets link."""
    sizes = same.select("id", "n", "bits")
    both = pairs.join(sizes.toDF("member", "n", "a"), "member").join(sizes.toDF("hub", "m", "b"), "hub")

    @F.arrow_udf("long")
    def differing(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([differing_bits(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], pa.int64())

    # Sets that link differ in at most this share of their n-grams; exact, nothing that links is lost.
    near = differing("a", "b") * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)
    pairs = scratch.store(both.where(near).select("hub", "member").distinct(), "close").df
    # A hub with very many members is dealt to several tasks.
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    salt = F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("salt")
    salted = pairs.join(parts, "hub").select("hub", salt, "member")
    none = F.lit(None).cast("long").alias("member")
    roles = salted.select(F.col("member").alias("id"), "hub", "salt", "member").unionByName(
        salted.select(F.col("hub").alias("id"), "hub", "salt", none).distinct()
    )
    # Of a set's copies one document gives the set, the one with the least id.
    one = same.select("id", F.col("one.doc_id").alias("one"), F.col("one.text_key").alias("text_key"))
    roles = scratch.store(roles.join(one, "id").drop("id"), "roles").df
    # Sent to the texts up to a fixed number of rows; beyond that the texts are joined.
    side = F.broadcast(roles) if roles.count() <= SENT_ROWS else roles
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"), "text")
    texts = texts.join(side, (F.col("own") == F.col("text_key")) & F.col("doc_id").eqNullSafe(F.col("one")))

    arrow = pa.schema([("hub", pa.int64()), ("salt", pa.int32()), ("member", pa.int64()), ("tokens", pa.binary())])
    sets = map_rows(
        texts.select("text_key", "text", "hub", "salt", "member"), lambda b: role_sets(b, k),
        "hub long, salt int, member long, tokens binary", arrow,
    )
    dealt = sets.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.asc_nulls_first("member"))
    found = map_rows(
        dealt, lambda b: verified_pairs(b, percent), "hub long, member long",
        pa.schema([("hub", pa.int64()), ("member", pa.int64())]),
    )
    return scratch.store(found, "links").df


def one_of_each(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` without the rows that link, over any number of links, to an earlier one.

    The row with the smallest id stays, of equal ids the one with the least text.
    Rows without words all stay. All columns are kept.
    """
    scratch = Scratch(documents.sparkSession)
    row = free_name(documents, "row")
    numbered = scratch.store(documents.withColumn(row, F.monotonically_increasing_id()), "rows").df
    # Row numbers stand in for ids, so that missing and repeated ids make no difference.
    ranked = numbered.select(F.col(row).alias("doc_id"), "text")
    grouped = near_duplicates(ranked, k, percent)
    ids = numbered.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    members = grouped.where("n_shingles > 0").withColumnRenamed("doc_id", "row").join(ids, "row")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    first = members.groupBy("component_id").agg(F.min_by("row", order).alias("keep"))
    dropped = members.join(first, "component_id").where("row <> keep")
    gone = scratch.store(dropped.select(F.col("row").alias(row)), "gone").df
    return numbered.join(gone, row, "left_anti").select(*(F.col(f"`{c}`") for c in documents.columns))
