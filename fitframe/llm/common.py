"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fitframe.plans.scratch import Scratch, StoredTable

# How many bytes of rows an executor and its Python process hold at a time on their way between the two.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

# White space that separates words, as a regular expression.
SPACES = r"[\x20\x09-\x0D]+"


def is_held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls on ``fold`` modulo ``folds``.

    Rows without an id belong to no fold.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def texts_of(batch: pa.RecordBatch, column: int) -> Iterator[str]:
    """The texts of a batch one by one, null as empty."""
    for value in batch.column(column):
        yield value.as_py() or ""


def in_batches(
    rows: Iterator[tuple], schema: pa.Schema, size: int = 4096, most_bytes: int = 8 << 20
) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of a bounded length and, roughly, of bounded bytes."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= size or weight >= most_bytes:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside gives Python functions at most ``BATCH_BYTES``, roughly, at a time."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def give_back() -> None:
    """Return freed memory to the system: the process waits for further tasks and would hold it meanwhile."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(column, f.type) for column, f in zip(zip(*rows), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def scored_by(function: Callable[[list[str]], np.ndarray], text: Column, step: int = 512) -> Column:
    """A double per text from a function of a few texts at a time; null is the empty text."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        parts = (column.slice(at, step) for at in range(0, len(column), step))
        scores = [function([t.as_py() or "" for t in part]) for part in parts]
        return pa.array(np.concatenate(scores) if scores else [], pa.float64())

    return score(text)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


HOT_KEYS = 1000


def hot_join(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """Inner join with ``right``, which has one row per key, over a key that may be hot in ``left``.

    ``sizes(key, size)`` counts the rows of ``left``. Keys with more than one in
    ``HOT_KEYS`` of them, so fewer than ``HOT_KEYS`` keys, are sent to all tasks with
    their rows of ``right``; all others are shuffled.
    """
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    hot = sizes.where(F.col("size") * HOT_KEYS > total).select(key)
    hot = scratch.store(hot.join(right.withColumn("_known", F.lit(True)), key, "left"), "hot").df
    often = left.join(F.broadcast(hot.where("_known").drop("_known")), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right, key)
    return often.unionByName(rest)


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of the edges ``(a, b)``, as ``(id, component)``.

    ``component`` is the smallest id in it; ids without an edge to another id
    have no row. Distributed union-find by contraction: each vertex joins the
    neighbour (or itself) with the least hash, edges are rewritten to those,
    and the rest goes on until no edge is left. The hash changes every round,
    so long chains shrink by a constant factor too. Every round's tables are
    written to the shared folder, which cuts lineage and lets adaptive
    execution split the joins of a vertex with very many edges.
    """
    edges = edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    held = scratch.store(edges.distinct(), "edges")
    edges = held.df
    if edges.isEmpty():
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    levels = []
    while True:
        order = lambda c: F.struct(F.xxhash64(F.lit(len(levels)), c).alias("h"), c.alias("v"))
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        chosen = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m")).select(
            F.col("a").alias("v"), F.least(order(F.col("a")), F.col("m"))["v"].alias("m")
        )
        chosen = scratch.store(chosen, "parents").df
        levels.append(chosen)
        left = chosen.select(F.col("v").alias("a"), F.col("m").alias("ma"))
        right = chosen.select(F.col("v").alias("b"), F.col("m").alias("mb"))
        rest = edges.join(left, "a").select("b", "ma").join(right, "b").where("ma <> mb")
        rest = rest.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b"))
        after = scratch.store(rest.distinct(), "edges")
        scratch.discard(held)
        held, edges = after, after.df
        if edges.isEmpty():
            break
    root = levels.pop()
    for level in reversed(levels):
        deeper = root.select(F.col("v").alias("m"), F.col("m").alias("r"))
        root = level.join(deeper, "m", "left").select("v", F.coalesce("r", "m").alias("m"))
        root = scratch.store(root, "roots").df
    least = root.groupBy("m").agg(F.least(F.col("m"), F.min("v")).alias("component"))
    least = scratch.store(least, "least").df
    return root.join(least, "m").select(F.col("v").alias("id"), "component")


def map_rows(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: str, arrow: pa.Schema
) -> DataFrame:
    """``mapInArrow`` for a function that yields tuples."""

    def run(batches):
        yield from in_batches(function(batches), arrow)
        give_back()

    return df.mapInArrow(run, schema)


def still_mixed(lists: DataFrame, known: DataFrame, scratch: Scratch, members: DataFrame | None = None) -> StoredTable:
    """``token, id, component`` of the lists ``token, id`` whose members are in several components, and ``s`` of ``members``."""
    places = lists.select("token", "id").join(known.hint("shuffle_hash"), "id", "left")
    places = scratch.store(places.select("token", "id", F.coalesce("component", "id").alias("component")), "places")
    mixed = places.df.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    place = places.df.join(mixed.where("lo <> hi").select("token"), "token", "left_semi")
    if members is not None:
        place = place.join(members.select("id", "s"), "id")
    place = scratch.store(place, "mixed")
    scratch.discard(places)
    return place


def pairs_of(place: DataFrame) -> DataFrame:
    """The pairs of each list whose sides are in different components, columns named ``.._a`` and ``.._b``."""
    left, right = (place.select("token", *(F.col(c).alias(f"{c}_{side}") for c in place.columns if c != "token")) for side in "ab")
    return left.join(right, "token").where("component_a < component_b")


def crowded(place: DataFrame) -> DataFrame:
    sizes = place.groupBy("token").agg(F.count(F.lit(1)).alias("size"))
    return place.join(sizes.where(F.col("size") > CROWDED).select("token"), "token", "left_semi")


def hub_pairs(place: DataFrame, fits: Callable[[Column, Column], Column]) -> DataFrame:
    """``hub, member``: up to ``HUBS`` members of each list, by hash, with those of other components that fit."""
    order = F.xxhash64("id")
    hubs = place.groupBy("token", F.pmod(order, F.lit(HUBS)).alias("slot")).agg(F.min_by("id", order).alias("id"))
    hubs = place.join(hubs.select("token", "id"), ["token", "id"])
    hubs = hubs.select("token", *(F.col(c).alias(f"{c}_b") for c in ("id", "component", "s")))
    met = place.join(hubs, "token").where((F.col("component") != F.col("component_b")) & fits(F.col("s"), F.col("s_b")))
    return met.select(F.least("id", "id_b").alias("hub"), F.greatest("id", "id_b").alias("member")).distinct()


#: Lists of more members are crowded; so many hubs a list before all its pairs.
CROWDED, HUBS = 16, 32


def shared_lists(lists: DataFrame, scratch: Scratch) -> StoredTable:
    """``token, id, top`` of the lists ``id, token, w`` with several members; ``top`` is the one of most weight."""
    # Ties are broken by a hash, so that one member is the first of all its lists.
    weight = F.col("w") + F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    tops = lists.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.max_by("id", weight).alias("top"))
    # Few tokens are shared: those fit a hash table per partition, and the long lists need no sort.
    active = lists.select("token", "id").join(tops.where("size > 1").select("token", "top").hint("shuffle_hash"), "token")
    return scratch.store(active, "lists")


def linked_members(
    lists: DataFrame, verified: Callable[[DataFrame], DataFrame], scratch: Scratch,
    members: DataFrame | None = None, fits: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """``linked_in`` for lists ``id, token, w`` as they are, of one member too."""
    return linked_in(shared_lists(lists, scratch), verified, scratch, members, fits)


def linked_in(
    active: StoredTable, verified: Callable[[DataFrame], DataFrame], scratch: Scratch,
    members: DataFrame | None = None, fits: Callable[[Column, Column], Column] | None = None,
    sketched: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``id, component`` of the members that link to another one; the lists are deleted on the way.

    ``shared_lists`` says under which tokens a member is met, and by which other members.
    Two members are candidates when they meet; with ``members(id, s, l)``, when they
    meet under at least as many tokens as the smaller of their ``l`` and ``fits`` holds
    for their sketches ``s``. ``verified`` turns candidates ``hub, member`` into those
    that link, as a table that does not read the candidates any more.

    First, members are verified against the member of most weight of their lists only:
    the one that all others of a group were most likely made from. Each member tries
    the one it meets most often. What links is one component. Then the pairs of a list
    that are still in different components follow, all of them; a pair within one
    component can change nothing any more.

    ``sketched`` turns a table of ``id`` into ``id, s``, for members that are in crowded
    lists. Only pairs of theirs for which ``fits`` holds become rows, and before all pairs
    are compared, several members of each such list are hubs of the rest: a group of
    near copies mostly becomes one component by these.
    """
    def enough(met: DataFrame, a: str, b: str) -> DataFrame:
        if members is None:
            return met
        own, other = members.toDF(a, "s", "l"), members.toDF(b, "t", "o")
        met = met.join(own, a).join(other, b).where(F.col("times") >= F.least("l", "o"))
        return met.where(fits(F.col("s"), F.col("t")))

    met = active.df.where("id <> top").groupBy("id", F.col("top").alias("hub")).agg(F.count(F.lit(1)).alias("times"))
    most = F.col("times") + F.pmod(F.xxhash64("hub"), F.lit(1 << 20)) / float(1 << 20)
    best = enough(met, "id", "hub").groupBy("id").agg(F.max_by("hub", most).alias("hub"))
    first = scratch.store(best.select("hub", F.col("id").alias("member")), "pairs")
    edges = lambda pairs: pairs.select(F.col("hub").alias("a"), F.col("member").alias("b"))
    known = scratch.store(components(edges(verified(first.df)), scratch), "known").df
    scratch.discard(first)

    place = still_mixed(active.df, known, scratch, members)
    scratch.discard(active)
    crowd = None
    if sketched is not None:
        crowd = scratch.store(crowded(place.df), "crowded")
        if crowd.df.isEmpty():
            scratch.discard(crowd)
            crowd = None
    if crowd is not None:
        sketches = scratch.store(sketched(crowd.df.select("id").distinct()), "sketches").df
        tried = scratch.store(hub_pairs(crowd.df.join(sketches, "id"), fits), "tried")
        old = known.select(F.col("id").alias("hub"), F.col("component").alias("member"))
        known = scratch.store(components(edges(old).unionByName(edges(verified(tried.df))), scratch), "known").df
        scratch.discard(tried)
        rest = scratch.store(place.df.join(crowd.df.select("token").distinct(), "token", "left_anti"), "rest")
        scratch.discard(place)
        place = still_mixed(rest.df, known, scratch)
        scratch.discard(rest)
        before, crowd = crowd, still_mixed(crowd.df, known, scratch)
        scratch.discard(before)
    pairs = pairs_of(place.df)
    if members is None:
        met = pairs.select(F.col("id_a").alias("hub"), F.col("id_b").alias("member"))
        if crowd is not None:
            near = pairs_of(crowd.df.join(sketches, "id")).where(fits(F.col("s_a"), F.col("s_b")))
            met = met.unionByName(near.select(F.col("id_a").alias("hub"), F.col("id_b").alias("member")))
        met = met.distinct()
    else:
        pairs = pairs.where(fits(F.col("s_a"), F.col("s_b")))
        met = pairs.groupBy(F.col("id_a").alias("hub"), F.col("id_b").alias("member")).agg(F.count(F.lit(1)).alias("times"))
        sizes = members.select("id", "l")
        met = met.join(sizes.toDF("hub", "l"), "hub").join(sizes.toDF("member", "o"), "member")
        met = met.where(F.col("times") >= F.least("l", "o")).select("hub", "member")
    second = scratch.store(met, "pairs")
    scratch.discard(place)
    if crowd is not None:
        scratch.discard(crowd)
    if second.df.isEmpty():
        return known
    old = known.select(F.col("id").alias("a"), F.col("component").alias("b"))
    links = edges(verified(second.df))
    scratch.discard(second)
    return components(old.unionByName(links), scratch)
