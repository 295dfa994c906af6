"""Mixing sources to target weights, in whole epochs and a weighted sample.

Targets: each source's share of the mix follows its weight, up to ``most`` times
its own size; what such a source cannot take is shared out among the others.
A target of at least one source size means complete epochs first; the rest
is an Efraimidis-Spirakis sample: documents in the order of exponential keys
``-ln(u) / weight``, the lightest key first, taken until the budget is reached.
The document at the edge gives as many words as the budget has left.

The order within a source is never computed in one place: keys fall into
buckets of a fixed width in log(key), where a bucket has at most about 0.1 %
of a source's documents whatever the size, running sums are taken per bucket,
and the totals of the buckets before are added. Only the table of sources,
one row each, is ordered as a whole.

Defined cases: null and empty texts have size 0 and take 0; null sources are
one source, after all others; sources of size 0 get target 0; rows that agree
in id and size are interchangeable; extra columns pass through ``mix`` untouched
unless they start with an underscore followed by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fitframe.llm.common import words_of
from fitframe.plans.scratch import Scratch

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
BUCKETS_PER_OCTAVE = 512
SOURCE = ["_mix_null", "_mix_source"]


def variety(words: Column) -> Column:
    """Share of distinct words, the quality weight of a document; at least 0.05."""
    n = F.size(words)
    return F.when(n > 0, F.greatest(F.size(F.array_distinct(words)) / n, F.lit(0.05))).otherwise(1.0)


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) from the md5 of the id as text; a missing id counts as ''."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def with_targets(sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Adds ``_mix_target`` to one row per source with its ``total``.

    Sources are filled up in the order of cap / weight: one is capped if the
    even level of all sources not yet filled would exceed its cap.
    """
    everything = Window.partitionBy(F.lit(0))
    position = F.row_number().over(everything.orderBy(*SOURCE))
    pick = F.array(*(F.lit(float(w)) for w in weights))
    weighed = sources.withColumn("weight", F.element_at(pick, (F.pmod(position - 1, F.lit(len(weights))) + 1)))
    weighed = weighed.withColumn("cap", F.col("total") * most)
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), *SOURCE)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    budget = F.sum("total").over(everything) * share
    level = (budget - F.coalesce(F.sum("cap").over(before), zero)) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)
    )
    marked = weighed.withColumn("capped", F.col("cap") / F.col("weight") < level)
    full = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(zero)).over(everything)
    open_weight = F.sum(F.when(F.col("capped"), zero).otherwise(F.col("weight"))).over(everything)
    rest = F.sum("total").over(everything) * share - full
    target = F.when(F.col("capped"), F.col("cap")).otherwise(rest / open_weight * F.col("weight"))
    return marked.select(*SOURCE, F.col("total").alias("_mix_total"), target.alias("_mix_target"))


def mix(
    documents: DataFrame, columns: Sequence[str], weights: Sequence[int] = WEIGHTS,
    share: float = SHARE, most: float = MOST,
) -> DataFrame:
    """The named columns with ``_mix_size, _mix_total, _mix_target, _mix_taken, _mix_copies``.

    ``_mix_taken`` counts words, ``_mix_copies`` whole documents: the epochs, and one
    more if the sample takes at least half of the document.
    """
    words = words_of(F.col("text"))
    key = F.greatest(-F.log(uniform(F.col("doc_id"))) / F.col("_mix_weight"), F.lit(1e-300))
    base = documents.select(
        *columns,
        *({"doc_id"} - set(columns)),
        F.col("source").isNull().alias("_mix_null"),
        F.coalesce(F.col("source"), F.lit("")).alias("_mix_source"),
        F.size(words).cast("long").alias("_mix_size"),
        variety(words).alias("_mix_weight"),
        F.xxhash64("text").alias("_mix_tie"),
    ).withColumn("_mix_key", key)
    bucket = F.floor(F.log2("_mix_key") * BUCKETS_PER_OCTAVE)
    base = base.withColumn("_mix_bucket", bucket).drop("_mix_weight")
    place = [*SOURCE, "_mix_bucket"]
    sums = base.groupBy(*place).agg(F.sum("_mix_size").alias("words"))
    sums = Scratch(documents.sparkSession).store(sums, "mix").df
    targets = with_targets(sums.groupBy(*SOURCE).agg(F.sum("words").alias("total")), weights, share, most)
    along = Window.partitionBy(*SOURCE).orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*place, F.coalesce(F.sum("words").over(along), F.lit(0)).alias("_mix_before"))
    plan = before.join(targets, SOURCE)

    running = Window.partitionBy(*place).orderBy("_mix_key", "doc_id", "_mix_size", "_mix_tie")
    inside = F.sum("_mix_size").over(running.rowsBetween(Window.unboundedPreceding, -1))
    ordered = base.withColumn("_mix_inside", F.coalesce(inside, F.lit(0)))
    joined = ordered.join(plan, place)
    total, target, size = F.col("_mix_total"), F.col("_mix_target"), F.col("_mix_size")
    epochs = F.when(total > 0, F.floor(target / total)).otherwise(0).cast("long")
    extra = F.round(target - epochs * total).cast("long")
    left = extra - F.col("_mix_before") - F.col("_mix_inside")
    part = F.greatest(F.lit(0).cast("long"), F.least(size, left))
    sampled = ((part > 0) & (2 * part >= size)).cast("long")
    return joined.select(
        *columns, "_mix_size", "_mix_total", "_mix_target",
        (size * epochs + part).alias("_mix_taken"), (epochs + sampled).alias("_mix_copies"),
    )


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken whole.

    Complete epochs hold every document of the source, those without words too;
    the sample on top never takes those.
    """
    taken = mix(documents, documents.columns, **options).where("_mix_copies > 0")
    repeats = F.explode(F.array_repeat(F.lit(0), F.col("_mix_copies").cast("int"))).alias("_mix_copy")
    return taken.select(*documents.columns, repeats).drop("_mix_copy")
