"""Fuzzy removal of repeated lines, with built-in functions only.

Equal lines are one class from the start, told from others by 128 bits of hashes. A
class's signature is the ``ENTRIES`` least hashes of its character shingles. To keep
the signature cheap its shingles are those of ``WIDE`` characters that start at a word,
or at every character where words are long; verification uses the 32-bit hashes
of all shingles of ``NARROW`` characters. Bands are the pairs of the first ``BANDED`` entries: two classes
are candidates if these share two, which for lines of Jaccard similarity 0.8 happens in
about 97 of 100 cases and above 0.9 in more than 99. Candidates are left out whose whole
signatures share less than half, or whose numbers of shingles lie far apart.
Candidates whose exact similarity is at least ``least_alike`` link; where lines are in many
pairs, a sketch of fixed size first tells most of those that cannot. Components of links
are found by distributed union-find, and of each component only one line stays: the
first by document id, then by place.

Defined cases: lines shorter than ``least_chars`` are neither removed nor compared,
blank ones included, so equal short lines all stay; null texts stay null and empty ones
empty; a document whose every line goes is empty afterwards and, in
``without_repeated_lines``, leaves the table; rows without an id come last in the order
of ids, equal ids go by row; extra columns pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fitframe.llm.common import free_name, linked_in, shared_lists
from fitframe.plans.scratch import Scratch

NARROW, WIDE = 5, 9
ENTRIES, BANDED = 8, 4
LEAST_SHARED, LEAST_RATIO = 0.5, 0.6
LONG_WORDS = 12
#: Longs of a line's sketch, a power of two, and from how many pairs per line on sketches pay.
SKETCH, PAIRS_PER_LINE = 16, 2
LAST = (1 << 63) - 1


def shingles(text: Column, width: int) -> Column:
    """The runs of up to ``width`` characters that start at a word."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{width}}}))[^ ]+ *"), F.lit(1))


def all_shingles(text: Column, width: int) -> Column:
    """The distinct hashes of the runs of ``width`` characters, or of the whole text if it is shorter."""
    runs = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1))
    return distinct_hashes(F.when(F.length(text) < width, F.array(text)).otherwise(runs))


def distinct_hashes(texts: Column) -> Column:
    return F.array_distinct(F.transform(texts, lambda s: F.xxhash64(s)))


def narrow_hashes(text: Column) -> Column:
    """The distinct 32-bit hashes of the runs of ``NARROW`` characters, or of the whole text if it is shorter.

    Every character of UTF-32 has four bytes, so runs are cut out by place, without matching.
    """
    size = 4 * NARROW

    def runs(coded: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.octet_length(coded) - (size - 1), F.lit(1)), F.lit(4))
        return F.transform(starts, lambda at: F.hash(F.substring(coded, at, F.lit(size))))

    # A lambda's argument is computed once, however often it is used.
    return F.array_distinct(F.get(F.transform(F.array(F.encode(text, "UTF-32")), runs), F.lit(0)))


def signature_shingles(line: Column) -> Column:
    words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    at_words = distinct_hashes(shingles(line, WIDE))
    return F.when(F.length(line) > words * LONG_WORDS, all_shingles(line, WIDE)).otherwise(at_words)


def entry_names() -> list[str]:
    return [f"e{i}" for i in range(ENTRIES)]


def bands() -> Column:
    """A key per pair of the first signature entries; the entry itself if there is one only."""
    entries = [F.col(e) for e in entry_names()[:BANDED]]
    pairs = [
        F.when(entries[j].isNotNull(), F.xxhash64(entries[i], entries[j]))
        for i in range(BANDED) for j in range(i + 1, BANDED)
    ]
    return F.array_compact(F.array(*pairs, F.when(entries[1].isNull(), entries[0])))


def lines_of(numbered: DataFrame, least_chars: int) -> DataFrame:
    """``row, order, at, line``: the lines that are compared."""
    split = numbered.select("row", "order", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return split.where(F.length("line") >= least_chars)


def line_keys() -> list[Column]:
    """128 bits by which equal lines are told from others."""
    return [F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")]


def line_classes(numbered: DataFrame, least_chars: int) -> DataFrame:
    """``id, h, g, row, at, size, n, e0 ..``: equal lines, one place of theirs, and their signature."""
    hashes = signature_shingles(F.col("line"))
    keyed = lines_of(numbered, least_chars).select("row", "at", *line_keys(), hashes.alias("hashes"))
    keyed = keyed.select("row", "at", "h", "g", F.size("hashes").alias("n"), F.sort_array("hashes").alias("hashes"))
    entries = [F.get("hashes", F.lit(i)).alias(e) for i, e in enumerate(entry_names())]
    keyed = keyed.select("row", "at", "h", "g", "n", *entries)
    # Equal lines have equal entries, so any aggregate of them will do. All buffers are
    # numbers, which hash aggregation combines before the shuffle without sorting.
    classes = keyed.groupBy("h", "g").agg(
        F.min("row").alias("row"), F.min_by("at", "row").alias("at"), F.count(F.lit(1)).alias("size"), *(F.min(c).alias(c) for c in ("n", *entry_names()))
    )
    return classes.select(F.monotonically_increasing_id().alias("id"), "*")


def may_be_alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The candidates ``hub, member`` whose signatures are alike enough."""
    sketch = classes.select("id", "n", F.array_compact(F.array(*entry_names())).alias("entries"))
    both = sketch.toDF("member", "na", "a").join(pairs.hint("shuffle_hash"), "member")
    both = sketch.toDF("hub", "nb", "b").join(both.hint("shuffle_hash"), "hub")
    shared = F.size(F.array_intersect("a", "b")) >= LEAST_SHARED * F.least(F.size("a"), F.size("b"))
    sizes = F.least("na", "nb") >= LEAST_RATIO * F.greatest("na", "nb")
    return both.where(sizes & shared).select("hub", "member")


def sketches(sets: DataFrame) -> DataFrame:
    """``id, n, b0 ..``: a set's size, and for each class of hashes whether it holds an odd number of them."""
    hashes = sets.select("id", F.explode("whole").alias("s"))
    bit, word = F.expr("shiftleft(1L, s & 63)"), F.expr(f"(s >> 6) & {SKETCH - 1}")
    words = (F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{i}") for i in range(SKETCH))
    return hashes.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *words)


def may_reach(a: list[Column], b: list[Column], least_alike: float) -> Column:
    """False only for sketches ``n, b0 ..`` of sets that are less alike.

    An odd class that is not odd in the other set holds a hash that only one of them has, and
    sets that are alike differ in at most (1 - s) / (1 + s) of their hashes.
    """
    differ = sum(F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a[1:], b[1:], strict=True))
    sizes = F.least(a[0], b[0]) >= F.greatest(a[0], b[0]) * least_alike - 1e-6
    return sizes & (differ * (1 + least_alike) <= (a[0] + b[0]) * (1 - least_alike) + 1e-6)


def not_far_apart(pairs: DataFrame, sets: DataFrame, scratch: Scratch, least_alike: float) -> DataFrame:
    """The candidates ``hub, member`` without those whose sketches show that they cannot be alike. Nothing alike is lost."""
    found = scratch.store(sketches(sets), "sketches")
    names = {x: [f"{x}n", *(f"{x}{i}" for i in range(SKETCH))] for x in "ab"}
    both = pairs.join(found.df.toDF("member", *names["a"]), "member").join(found.df.toDF("hub", *names["b"]), "hub")
    near = may_reach(*([F.col(c) for c in names[x]] for x in "ab"), least_alike)
    close = scratch.store(both.where(near).select("hub", "member"), "near").df
    scratch.discard(found)
    return close


def cut_lines(wanted: DataFrame, numbered: DataFrame) -> DataFrame:
    """The columns of ``wanted(row, at, ..)`` but these two, and ``line``, cut out of its text."""
    # Only these lines leave their texts, which stay where they are.
    others = [c for c in wanted.columns if c not in ("row", "at")]
    by_row = wanted.groupBy("row").agg(F.collect_list(F.struct("at", *others)).alias("wanted"))
    texts = numbered.select("row", F.split("text", "\n").alias("lines")).join(by_row.hint("shuffle_hash"), "row")
    lines = texts.select("lines", F.explode("wanted").alias("w"))
    return lines.select(*(F.col(f"w.{c}") for c in others), F.get("lines", F.col("w.at")).alias("line"))


def met_lines(ids: DataFrame, numbered: DataFrame, classes: DataFrame) -> DataFrame:
    """``id, n, e0 .., line`` of the classes that meet others at all, which every later step looks up."""
    met = classes.join(ids.distinct().hint("shuffle_hash"), "id", "left_semi")
    return cut_lines(met.select("id", "row", "at", "n", *entry_names()), numbered)


def lines_at(ids: DataFrame, numbered: DataFrame, classes: DataFrame) -> DataFrame:
    """``id, line`` of these lines, which ``classes`` holds as ``line`` or by their place."""
    if "line" in classes.columns:
        return classes.select("id", "line").join(ids.hint("shuffle_hash"), "id")
    return cut_lines(classes.select("id", "row", "at").join(ids.hint("shuffle_hash"), "id"), numbered)


def whole_sets(ids: DataFrame, numbered: DataFrame, classes: DataFrame) -> DataFrame:
    """``id, whole``: the hashes of all shingles of these lines."""
    return lines_at(ids, numbered, classes).select("id", narrow_hashes(F.col("line")).alias("whole"))


def alike_lines(
    pairs: DataFrame, numbered: DataFrame, classes: DataFrame, scratch: Scratch, least_alike: float
) -> DataFrame:
    """The candidates ``hub, member`` whose lines are alike, by all their shingles."""
    ids = pairs.select("hub").unionByName(pairs.select(F.col("member").alias("hub"))).distinct().toDF("id")
    ids = scratch.store(ids, "ids")
    if pairs.count() > PAIRS_PER_LINE * ids.df.count():
        # Lines of many pairs get their sets once.
        held = scratch.store(whole_sets(ids.df, numbered, classes), "sets")
        pairs = not_far_apart(pairs, held.df, scratch, least_alike)
        both = with_both(pairs, held.df, "whole").select("hub", "member", "a", "b")
    else:
        # Else sets are made where a pair meets, from lines, which are several times smaller.
        held = ids
        if "line" not in classes.columns:
            held = scratch.store(lines_at(ids.df, numbered, classes), "cut")
            classes = held.df
        both = with_both(pairs, classes, "line")
        # Generated columns are computed once, however often a condition reads them.
        sets = F.struct(narrow_hashes(F.col("a")).alias("a"), narrow_hashes(F.col("b")).alias("b"))
        both = both.select("hub", "member", F.inline(F.array(sets)).alias("a", "b"))
    links = scratch.store(both.where(alike_sets(F.col("a"), F.col("b"), least_alike)).select("hub", "member"), "links").df
    for table in {t.name: t for t in (ids, held)}.values():
        scratch.discard(table)
    return links


def with_both(pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """The pairs ``hub, member`` with a column of ``rows``, one row per ``id``: the member's as ``a``, the hub's as ``b``."""
    # Each line has one row, so these fit hash tables, and wide pairs need no sort.
    rows = rows.select("id", column)
    both = pairs.join(rows.toDF("member", "a").hint("shuffle_hash"), "member")
    return both.join(rows.toDF("hub", "b").hint("shuffle_hash"), "hub")


def alike_sets(a: Column, b: Column, least_alike: float) -> Column:
    """Whether the sets' Jaccard similarity is ``least_alike`` or more."""
    # Sizes alone tell some; the sets of the others are intersected once.
    sizes = F.least(F.size(a), F.size(b)) >= F.greatest(F.size(a), F.size(b)) * least_alike - 1e-6
    least_common = (F.size(a) + F.size(b)) * (least_alike / (1 + least_alike)) - 1e-6
    return sizes & (F.size(F.array_intersect(a, b)) >= least_common)


def removed_lines(
    numbered: DataFrame, scratch: Scratch, least_chars: int, least_alike: float
) -> DataFrame:
    """``row, removed``: the places of the lines that go, from 0 and ascending."""
    classes = scratch.store(line_classes(numbered, least_chars), "classes").df
    lists = classes.select("id", F.col("size").cast("double").alias("w"), F.explode(bands()).alias("token"))
    lists = shared_lists(lists, scratch)
    met = scratch.store(met_lines(lists.df.select("id"), numbered, classes), "met")

    def check(pairs: DataFrame) -> DataFrame:
        close = scratch.store(may_be_alike(pairs, met.df), "close")
        links = alike_lines(close.df, numbered, met.df, scratch, least_alike)
        scratch.discard(close)
        return links

    def sketched(ids: DataFrame) -> DataFrame:
        return sketches(whole_sets(ids, numbered, met.df)).select("id", F.struct(*parts).alias("s"))

    parts = ["n", *(f"b{i}" for i in range(SKETCH))]
    fits = lambda s, t: may_reach([s[c] for c in parts], [t[c] for c in parts], least_alike)
    linked = linked_in(lists, check, scratch, fits=fits, sketched=sketched)
    grouped = classes.select("id", "h", "g", "size").join(linked, "id", "left").where("size > 1 OR component IS NOT NULL")
    grouped = grouped.select("h", "g", F.coalesce("component", "id").alias("component"))
    grouped = scratch.store(grouped, "grouped").df
    scratch.discard(met)
    # Every place of a line that has others like it.
    own = lines_of(numbered, least_chars).select(*line_keys(), "row", "order", "at").join(grouped, ["h", "g"])
    own = scratch.store(own.select("component", "row", "order", "at"), "own").df
    first = own.groupBy("component").agg(F.min(F.struct("order", "row", "at")).alias("first"))
    first = first.select("component", F.col("first.row").alias("kept_row"), F.col("first.at").alias("kept_at"))
    gone = own.join(first, "component").where("row <> kept_row OR at <> kept_at")
    return gone.groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("removed"))


def with_removed(documents: DataFrame, least_chars: int, least_alike: float) -> tuple[DataFrame, str]:
    """``documents`` and a column with the places of the lines that go, null where all stay; its name."""
    scratch = Scratch(documents.sparkSession)
    row, removed = free_name(documents, "row"), free_name(documents, "removed")
    numbered = documents.withColumn(row, F.monotonically_increasing_id())
    # Bucketed by row: texts are shuffled once, and not again when lines are looked up or removed.
    buckets = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = scratch.store_bucketed(numbered, "numbered", [row], buckets).df
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    plain = numbered.select(F.col(row).alias("row"), order.alias("order"), "text")
    work = Scratch(documents.sparkSession)
    gone = removed_lines(plain, work, least_chars, least_alike).toDF(row, removed)
    gone = scratch.store(gone, "gone").df
    work.discard_all()
    return numbered.join(gone.hint("shuffle_hash"), row, "left").drop(row), removed


def without_places(text: Column, removed: Column) -> Column:
    """``text`` without the lines at these ascending places, by the stretches between them."""

    def rest(lines: Column) -> Column:
        edges = F.concat(F.array(F.lit(-1)), removed, F.array(F.size(lines)))
        return F.array_join(F.flatten(F.zip_with(
            edges, F.slice(edges, 2, F.size(edges) - 1),
            lambda start, end: F.slice(lines, start + 2, F.coalesce(end - start - 1, F.lit(0))),
        )), "\n")

    # A lambda's argument is computed once, however often it is used.
    once = F.transform(F.array(F.split(text, "\n")), rest)
    return F.when(removed.isNull(), text).otherwise(F.get(once, F.lit(0)))


def deduplicated(documents: DataFrame, least_chars: int = 20, least_alike: float = 0.8) -> DataFrame:
    """Every row of ``documents``, ``text`` without repeated lines, and ``n_removed``, how many they were."""
    found, removed = with_removed(documents, least_chars, least_alike)
    count = F.when(F.col(removed).isNull(), F.lit(0)).otherwise(F.size(removed)).cast("long")
    text = without_places(F.col("text"), F.col(removed))
    own = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns if c != "n_removed"]
    return found.select(*own, count.alias("n_removed"))


def without_repeated_lines(documents: DataFrame, least_chars: int = 20, least_alike: float = 0.8) -> DataFrame:
    """``documents`` with such texts; rows that lost their every line are left out.

    A column ``n_chars`` follows the new text.
    """
    found, removed = with_removed(documents, least_chars, least_alike)
    found = found.withColumn("text", without_places(F.col("text"), F.col(removed)))
    found = found.where(F.col(removed).isNull() | (F.trim("text") != ""))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        length = F.when(F.col(removed).isNull(), F.col("n_chars")).otherwise(F.length("text"))
        found = found.withColumn("n_chars", length.cast(kind))
    return found.select(*(F.col(f"`{c}`") for c in documents.columns))
