"""No row and no cell is left out without a word, in any layout."""

import pytest
from pyspark.sql import functions as F

from fitframe import DistributedMatrix, fit
from fitframe.examples import Examples
from fitframe.operators import vectors
from fitframe.operators.objective import evaluate, objective
from fitframe.operators.score import linear_scores
from fitframe.operators.split import hash_split
from fitframe.sources import examples_from_array, examples_from_arrays, examples_from_columns

SPARSE = "id long, label double, indices array<int>, values array<double>"
ROWS = [
    (1, 1.0, [0, 1], [1.0, 10.0]), (1, 0.0, [1, 2], [4.0, 200.0]), (None, 1.0, [0], [101.0]), (None, 0.0, [], []),
    (7, 0.0, [0, 1, 2], [1.0, 1.0, 1.0]),
]
SCORES = [21.0, 608.0, 101.0, 0.0, 6.0]


def weights(spark, *v):
    return spark.createDataFrame(list(enumerate(map(float, v))), "idx int, v double")


@pytest.mark.parametrize("broadcast_features", [100, 2, 0])
@pytest.mark.parametrize("id_col", ["id", None])
def test_missing_and_repeated_ids_score_alike_in_both_layouts(spark, broadcast_features, id_col):
    df = spark.createDataFrame(ROWS, SPARSE).withColumn("_row_id", F.lit("own"))
    scored = linear_scores(Examples(df, 3, id_col), weights(spark, 1, 2, 3), broadcast_features)
    assert scored.columns == [*df.columns, "z"]
    assert sorted(r["z"] for r in scored.collect()) == sorted(SCORES)


def test_training_on_missing_and_repeated_ids(spark):
    df = spark.createDataFrame(ROWS, SPARSE)
    sent, joined = (fit(Examples(df, 3, "id"), num_iters=4, broadcast_features=b) for b in (100, 0))
    assert [s[1] for s in sent.steps] == pytest.approx([s[1] for s in joined.steps])


@pytest.mark.parametrize("broadcast_features", [100, 0])
@pytest.mark.parametrize("row", [
    (9, None, [0], [1.0]), (9, 1.0, [3], [1.0]), (9, 1.0, [-1], [1.0]), (9, 1.0, [0], [None]), (9, 1.0, [None], [1.0]),
    (9, 1.0, [0, 1], [1.0]), (9, 1.0, None, [1.0]), (9, 1.0, [0], None),
])
def test_rows_that_do_not_fit_fail_training(spark, row, broadcast_features):
    examples = Examples(spark.createDataFrame([*ROWS, row], SPARSE), 3, "id")
    with pytest.raises(Exception, match="an example "):
        fit(examples, num_iters=2, broadcast_features=broadcast_features)
    for function in (evaluate, objective):
        with pytest.raises(Exception, match="an example "):
            function(examples, weights(spark, 1, 2, 3)).collect()


def test_tables_of_uneven_rows_fail(spark):
    rows = [(1.0, [1.0, 2.0]), (0.0, [1.0, 2.0, 3.0]), (0.0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "y double, x array<double>")
    assert examples_from_array(df, F.col("y"), F.col("x")).num_features == 3
    for width in (None, 2, 3):
        with pytest.raises(Exception, match="whose values are not"):
            examples_from_array(df, F.col("y"), F.col("x"), width).df.collect()
    with pytest.raises(ValueError, match="no examples"):
        examples_from_array(df.where("y > 5"), F.col("y"), F.col("x"))
    missing = spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "y double, a double")
    with pytest.raises(Exception, match="without a label"):
        examples_from_columns(missing, F.col("y"), [F.col("a")]).df.collect()
    with pytest.raises(Exception, match="whose values are not"):
        examples_from_columns(missing, F.lit(1.0), [F.col("y")]).df.collect()
    sparse = spark.createDataFrame([(1.0, [5], [1.0])], "y double, i array<int>, v array<double>")
    with pytest.raises(Exception, match="an index outside"):
        examples_from_arrays(sparse, F.col("y"), F.col("i"), F.col("v"), 5).df.collect()


def test_rows_without_a_key_are_in_one_part(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (3, "c"), (0, "d")], "k long, v string")
    parts = [sorted(r["v"] for r in p.collect()) for p in hash_split(df, "k")]
    assert sorted(sum(parts, [])) == ["a", "b", "c", "d"]
    assert any({"a", "b", "d"} <= set(p) for p in parts)


def matrix(spark, rows, num_rows=None, num_cols=None):
    return DistributedMatrix.from_rows(spark.createDataFrame(rows, "idx int, row array<double>"), num_rows, num_cols)


def test_matrices_of_other_rows_do_not_join(spark):
    a = matrix(spark, [(0, [1.0]), (1, [2.0])])
    with pytest.raises(Exception, match="has no row 1"):
        a.concat(matrix(spark, [(0, [1.0]), (2, [2.0])])).rows.orderBy("idx").collect()
    for v in ([(0, 1.0)], [(0, 1.0), (1, 2.0), (2, 3.0)]):
        with pytest.raises(Exception, match="has no row"):
            a.append_column(spark.createDataFrame(v, "idx int, v double")).rows.collect()
    assert a.concat(a).append_column(weights(spark, 5, 6)).rows.orderBy("idx").collect()[1]["row"] == [2.0, 2.0, 6.0]


def test_gram_of_ragged_rows_fails(spark):
    for rows in ([(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0]), (2, [1.0])], [(0, [1.0, 2.0]), (1, None)]):
        with pytest.raises(Exception, match="a row that does not have"):
            matrix(spark, rows).gram().collect()


def test_cells_outside_of_the_sizes_fail(spark):
    for cell in ((2, 0, 1.0), (0, 3, 1.0), (-1, 0, 1.0), (0, None, 1.0), (None, 0, 1.0)):
        cells = spark.createDataFrame([(0, 0, 1.0), cell], "idx int, col int, v double")
        with pytest.raises(Exception, match="a cell outside of 2 x 3"):
            DistributedMatrix.from_cells(cells, 2, 3).rows.collect()
    for idx in (3, -1, None):
        with pytest.raises(Exception, match="an index outside"):
            vectors.completed(spark.createDataFrame([(0, 1.0), (idx, 1.0)], "idx int, v double"), 3).collect()
