import os
import re

from pyspark import StorageLevel
from pyspark.sql import functions as F

from fitframe import LOGISTIC
from fitframe.plans.evaluation import Evaluation
from fitframe.plans.scoring import BroadcastScores, JoinScores, frequent_features, scores_for
from fitframe.plans.scratch import Scratch, shared_folder, temporary_tables

from checks import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_broadcast_gradient_shuffles_only_partial_sums(spark, small):
    examples = tables.line_examples(spark, small)
    text = plan(Evaluation(BroadcastScores(examples), LOGISTIC).sums(tables.ramp(spark, 4)))
    main = text.split("Subquery")[0]
    assert main.count("Exchange") == 1
    assert main.index("Exchange") < main.index("partial_sum")


def test_scan_reads_only_the_features(spark, small):
    text = plan(BroadcastScores(tables.line_examples(spark, small)).add({"z": tables.ramp(spark, 4)}))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"
    }


def test_cached_layouts_are_neither_shuffled_nor_sorted_again(spark, small):
    settings = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for setting in settings:
        spark.conf.set(setting, "-1")  # as with weights that are too long to send
    try:
        examples = tables.order_examples(spark, small)
        scores = JoinScores(examples, 0, storage=StorageLevel.MEMORY_AND_DISK)
        scored = scores.add({"z": tables.ramp(spark, tables.ONEHOT_FEATURES)})
        assert len(scored.collect()) == examples.df.count()
        final = plan(scored).split("\n+- == Initial Plan ==")[0].splitlines()
        scores.close()
    finally:
        for setting in settings:
            spark.conf.unset(setting)
    joins = [i for i, line in enumerate(final) if "SortMergeJoin" in line]
    scans = [i for i, line in enumerate(final) if "InMemoryTableScan" in line]
    assert len(scans) >= 2 and joins
    # The examples and the rare cells are the first inputs of their joins.
    for scan in scans[:2]:
        join = max(i for i in joins if i < scan)
        assert not any("Exchange" in line or "Sort " in line for line in final[join + 1 : scan])


def test_layout_by_size(spark, small):
    examples = tables.order_examples(spark, small)
    assert isinstance(scores_for(examples), BroadcastScores)
    assert isinstance(scores_for(examples, broadcast_features=35), JoinScores)


def frequent(spark, counts, limit):
    df = spark.createDataFrame(list(enumerate(counts)), "idx int, n long")
    rows = frequent_features(df, limit).orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(len(rows)))
    return [r["idx"] for r in rows]


def test_frequent_features(spark):
    counts = [1000, 3, 700, 5, 1, 100, 0, 2**40]
    assert frequent(spark, counts, 3) == [0, 2, 7]
    assert frequent(spark, counts, 4) == [0, 2, 5, 7]
    assert frequent(spark, counts, 8) == list(range(8))
    assert frequent(spark, [6, 5, 7, 4], 3) == []  # all of one size


def test_no_hot_feature_is_joined(spark):
    """For any counts, what stays to be joined is below an even share."""
    for seed in range(5):
        counts = [int(1e6 / (i + 1) ** (0.5 + seed / 4)) + 1 for i in range(500)]
        parts = 16
        kept = set(frequent(spark, counts, 2 * parts))
        assert len(kept) <= 2 * parts
        rest = [n for i, n in enumerate(counts) if i not in kept]
        assert max(rest) <= sum(counts) / parts


def test_scratch_tables(spark):
    scratch = Scratch(spark)
    table = scratch.store(spark.range(5), "ids")
    assert table.path.startswith(shared_folder(spark)) and table.df.count() == 5
    other = Scratch(spark).store(spark.range(1), "ids")
    try:
        scratch.discard(other)
        raise AssertionError("foreign table accepted")
    except ValueError:
        assert other.df.count() == 1
    scratch.discard(table)
    assert not os.path.exists(table.path)


def test_temporary_tables_end_with_their_block(spark):
    with temporary_tables():
        inner = Scratch(spark).store(spark.range(3), "ids")
        with temporary_tables():
            nested = Scratch(spark).store(spark.range(3), "ids")
        assert inner.df.count() == 3 and os.path.exists(inner.path)
        assert not os.path.exists(nested.path)
    assert not os.path.exists(os.path.dirname(inner.path))


def test_bucketed_tables_join_without_a_shuffle(spark):
    scratch = Scratch(spark)
    rows = spark.range(10_000).withColumn("v", F.rand(1))
    a, b = (scratch.store_bucketed(rows, name, ["id"], 4) for name in ("a", "b"))
    joined = a.df.hint("merge").join(b.df, "id").groupBy("id").agg(F.count(F.lit(1)))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == 10_000


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_folder(spark) == configured
