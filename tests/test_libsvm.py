import pytest
from pyspark.errors import PySparkException

from fitframe import read_libsvm
from fitframe.functions.arrays import to_dense
from fitframe.sources import infer_num_features, parse_libsvm


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def rows(df):
    return [(r["label"], r["indices"], r["values"]) for r in df.collect()]


def test_edge_lines(spark):
    parsed = parse_libsvm(
        lines(spark, "1 1:0.5 3:2.0", "-1  2:1.5 ", "# comment", "", "   2 1:1 2:2:9", "0", " \t ")
    )
    assert rows(parsed) == [
        (1.0, [0, 2], [0.5, 2.0]),
        (0.0, [1], [1.5]),
        (1.0, [0, 1], [1.0, 2.0]),
        (0.0, [], []),
    ]
    assert infer_num_features(parsed) == 3


def test_control_characters_are_trimmed(spark):
    assert rows(parse_libsvm(lines(spark, "\t\x01 1 1:2\x02\r"))) == [(1.0, [0], [2.0])]


@pytest.mark.parametrize(
    "label, expected",
    [("-1", 0.0), ("0", 0.0), ("-0.5", 0.0), ("0.5", 1.0), ("2", 1.0), ("1e3", 1.0), ("NaN", 1.0)],
)
def test_labels_become_binary(spark, label, expected):
    assert rows(parse_libsvm(lines(spark, f"{label} 1:1"))) == [(expected, [0], [1.0])]


BAD = ["x 1:1", "1 5", "1 1:2 # note", "1 0:3", "1 a:3", "1 1:b", "1 1.5:2", "1 3:", "1 :3", "1 1:2\t2:3"]


@pytest.mark.parametrize("line", BAD)
def test_bad_lines_fail(spark, line):
    with pytest.raises(PySparkException, match="not a LibSVM"):
        parse_libsvm(lines(spark, "1 1:1", line)).collect()


def test_bad_lines_fail_without_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(PySparkException, match="not a LibSVM"):
            parse_libsvm(lines(spark, "1 5")).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_bad_lines_dropped(spark):
    parsed = parse_libsvm(lines(spark, "1 1:1", *BAD, "0 2:1"), mode="drop")
    assert rows(parsed) == [(1.0, [0], [1.0]), (0.0, [1], [1.0])]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        parse_libsvm(lines(spark, "1"), mode="loose")


def test_unsorted_indices_count_in_full(spark):
    assert infer_num_features(parse_libsvm(lines(spark, "1 9:1 2:1"))) == 9


def test_rows_without_entries_mean_one_feature(spark):
    assert infer_num_features(parse_libsvm(lines(spark, "1", "0"))) == 1


def test_other_columns_are_kept(spark):
    df = spark.createDataFrame([(7, "1 1:2"), (8, "# no")], "id int, text string")
    assert [tuple(r) for r in parse_libsvm(df, "text").collect()] == [(7, 1.0, [0], [2.0])]


def test_read_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 1:1 4:2\n# x\n\n")
    (tmp_path / "b.txt").write_text("-1 2:1\n")
    examples = read_libsvm(spark, str(tmp_path))
    assert examples.num_features == 4 and examples.df.count() == 2
    assert read_libsvm(spark, str(tmp_path), num_features=10).num_features == 10
    split = read_libsvm(spark, str(tmp_path), num_features=4, num_partitions=5)
    assert split.df.rdd.getNumPartitions() == 5


def test_to_dense(spark):
    df = spark.createDataFrame(
        [(1, [2, 0, 2], [1.0, 5.0, 0.5]), (2, [], []), (3, [3, 9], [1.0, 1.0])],
        "id int, indices array<int>, values array<double>",
    )
    dense = df.select("id", to_dense("indices", "values", 4).alias("x")).collect()
    assert {r["id"]: r["x"] for r in dense} == {
        1: [5.0, 0.0, 1.5, 0.0],
        2: [0.0, 0.0, 0.0, 0.0],
        3: [0.0, 0.0, 0.0, 1.0],
    }
