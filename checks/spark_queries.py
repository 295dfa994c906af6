"""One query per operator, on the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks import tables as t
from fitframe import (
    LOGISTIC,
    DistributedMatrix,
    Examples,
    RankingCurve,
    fit,
    linear_scores,
    read_libsvm,
    run_job,
    score,
    train_and_rate,
)
from fitframe.functions.arrays import to_dense
from fitframe.operators import vectors
from fitframe.operators.direction import descent_direction
from fitframe.operators.objective import gradient, initial_weights, objective
from fitframe.operators.split import hash_split, random_split
from fitframe.plans.evaluation import Evaluation
from fitframe.plans.job import split_examples
from fitframe.plans.linesearch import first_acceptable, losses_at_steps
from fitframe.plans.scoring import BroadcastScores
from fitframe.plans.scratch import Scratch
from fitframe.sources import examples_from_columns, num_features_frame, parse_libsvm


def rounded(column: str, digits: int = 6, name: str | None = None) -> Column:
    """Rounded, with -0.0 turned to 0.0."""
    return (F.round(F.col(column), digits) + F.lit(0.0)).alias(name or column)


def parallel(spark: SparkSession, examples: Examples) -> Examples:
    """Spread small inputs over all cores; large ones have splits enough."""
    return examples.with_df(examples.df.repartition(spark.sparkContext.defaultParallelism))


# Sources


def parsed_cells(parsed: DataFrame) -> DataFrame:
    cells = parsed.select("vec_id", "label", F.explode(F.arrays_zip("indices", "values")).alias("c"))
    return cells.select(
        "vec_id", "label", F.col("c.indices").alias("idx"), F.col("c.values").alias("v")
    ).select("vec_id", "label", "idx", rounded("v"))


def libsvm_parse(spark, sf_dir):
    return parsed_cells(parse_libsvm(t.embedding_lines(spark, sf_dir)))


def libsvm_drop(spark, sf_dir):
    """Every ninth line broken; ``mode='drop'`` keeps the others."""
    lines = t.embedding_lines(spark, sf_dir)
    broken = lines.withColumn(
        "value", F.expr("if(vec_id % 9 = 0 AND value LIKE '%:%', concat(value, ' 7'), value)")
    )
    return parsed_cells(parse_libsvm(broken, mode="drop"))


def written_lines(spark: SparkSession, sf_dir: str) -> str:
    path = f"{Scratch(spark).root}/embedding-lines"
    t.embedding_lines(spark, sf_dir).select("value").write.text(path)
    return path


def libsvm_load(spark, sf_dir):
    """Text files, feature count inferred; summed up per label and feature."""
    examples = read_libsvm(spark, written_lines(spark, sf_dir))
    cells = examples.df.select("label", F.explode(F.arrays_zip("indices", "values")).alias("c"))
    return cells.groupBy("label", F.col("c.indices").alias("idx")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("c.values").alias("total")
    ).select("label", "idx", "n", rounded("total"), F.lit(examples.num_features).alias("num_features"))


def feature_count(spark, sf_dir):
    return num_features_frame(parse_libsvm(t.embedding_lines(spark, sf_dir)))


def examples_onehot(spark, sf_dir):
    return t.order_examples(spark, sf_dir).entries().select("row_id", "idx", rounded("v", 8))


def dense_row(spark, sf_dir):
    parsed = parse_libsvm(t.embedding_lines(spark, sf_dir))
    dense = parsed.select("vec_id", to_dense("indices", "values", t.EMBEDDING_SIZE).alias("x"))
    return dense.select("vec_id", F.posexplode("x").alias("idx", "v")).select(
        "vec_id", "idx", rounded("v")
    )


def start_weights(spark, sf_dir):
    """A partial start vector completed with zeros."""
    start = t.mean_vector(spark, sf_dir, 0).where("v > 0")
    return initial_weights(spark, t.EMBEDDING_SIZE, start).select("idx", rounded("v"))


# Splits


def split_counts(spark, sf_dir):
    train, test = hash_split(t.read(spark, sf_dir, "orders"), "o_orderkey")
    sides = train.select(F.lit("train").alias("side"), "o_totalprice").unionByName(
        test.select(F.lit("test").alias("side"), "o_totalprice")
    )
    return sides.groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")
    ).select("side", "n", rounded("total", 2))


def split_random(spark, sf_dir):
    """Both sides together hold every order once; close to 60/40."""
    train, test = random_split(t.read(spark, sf_dir, "orders").select("o_orderkey"))
    sides = train.withColumn("train", F.lit(1)).unionByName(test.withColumn("train", F.lit(0)))
    return sides.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("o_orderkey").alias("keys"),
        F.round(F.avg("train"), 1).alias("train_share"),
    )


# Per-example expressions


def scored_embeddings(spark, sf_dir) -> DataFrame:
    return linear_scores(t.embedding_examples(spark, sf_dir), t.ramp(spark, t.EMBEDDING_SIZE))


def linear_score(spark, sf_dir):
    return scored_embeddings(spark, sf_dir).select("vec_id", rounded("z"))


def linear_score_joined(spark, sf_dir):
    examples = t.order_examples(spark, sf_dir)
    scored = linear_scores(examples, t.ramp(spark, t.ONEHOT_FEATURES), broadcast_features=0)
    return scored.select("o_orderkey", rounded("z"))


def score_repeated_ids(spark, sf_dir):
    """Ids that repeat (a key of several lines) or are missing, weights joined in."""
    lines = t.read(spark, sf_dir, "lineitem").withColumn("key", F.expr("if(l_linenumber = 2, NULL, l_orderkey)"))
    features = [F.col(c) for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")]
    examples = examples_from_columns(lines, F.lit(1.0), features, id_col="key")
    scored = linear_scores(examples, t.ramp(spark, 4), broadcast_features=0)
    return scored.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("z")).select("key", "n", rounded("z"))


def residual(spark, sf_dir):
    r = LOGISTIC.residual(F.col("label"), F.col("z")).alias("r")
    return scored_embeddings(spark, sf_dir).select("vec_id", r).select("vec_id", rounded("r"))


def log_loss(spark, sf_dir):
    loss = LOGISTIC.value(F.col("label"), F.col("z")).alias("loss")
    return scored_embeddings(spark, sf_dir).select("vec_id", loss).select("vec_id", rounded("loss"))


def example_gradient(spark, sf_dir):
    r = LOGISTIC.residual(F.col("label"), F.col("z")).alias("r")
    cells = scored_embeddings(spark, sf_dir).select("vec_id", r, F.posexplode("values").alias("idx", "x"))
    return cells.select("vec_id", "idx", (F.col("r") * F.col("x")).alias("g")).select(
        "vec_id", "idx", rounded("g")
    )


# Sums over all examples


def objective_value(spark, sf_dir):
    examples = t.embedding_examples(spark, sf_dir)
    return objective(examples, t.ramp(spark, t.EMBEDDING_SIZE), reg=0.1).select(
        "examples", rounded("loss_sum"), rounded("objective")
    )


def gradient_dense(spark, sf_dir):
    examples = t.embedding_examples(spark, sf_dir)
    return gradient(examples, t.ramp(spark, t.EMBEDDING_SIZE), reg=0.1).select("idx", rounded("v", 8))


def gradient_short(spark, sf_dir):
    return gradient(t.line_examples(spark, sf_dir), t.ramp(spark, 4, -0.1), reg=0.1).select(
        "idx", rounded("v", 8)
    )


def gradient_sparse(spark, sf_dir):
    examples = t.order_examples(spark, sf_dir)
    return gradient(examples, t.ramp(spark, t.ONEHOT_FEATURES), reg=0.1).select("idx", rounded("v", 8))


def gradient_joined(spark, sf_dir):
    examples = t.order_examples(spark, sf_dir)
    weights = t.ramp(spark, t.ONEHOT_FEATURES)
    return gradient(examples, weights, reg=0.1, broadcast_features=0).select("idx", rounded("v", 8))


# Vectors


def vec_dot(spark, sf_dir):
    a, b = t.mean_vector(spark, sf_dir, 1), t.mean_vector(spark, sf_dir, 2)
    return vectors.dot(a, b).select(rounded("dot"))


def vec_axpy(spark, sf_dir):
    """Each side lacks indices that the other has."""
    a = t.mean_vector(spark, sf_dir, 1).where("v > 0")
    b = t.mean_vector(spark, sf_dir, 2).where("v < 0.05")
    return vectors.axpy(2.5, a, b).select("idx", rounded("v"))


def vec_scal(spark, sf_dir):
    return vectors.scal(-3.0, t.mean_vector(spark, sf_dir, 1)).select("idx", rounded("v"))


def vec_norm2(spark, sf_dir):
    return vectors.norm2(t.mean_vector(spark, sf_dir, 1)).select(rounded("norm"))


def vec_plus_minus(spark, sf_dir):
    a, b = t.mean_vector(spark, sf_dir, 1), t.mean_vector(spark, sf_dir, 2)
    both = vectors.plus(a, b).withColumnRenamed("v", "sum").join(
        vectors.minus(a, b).withColumnRenamed("v", "difference"), "idx"
    )
    return both.select("idx", rounded("sum"), rounded("difference"))


# Matrices


def matrix_cells(matrix: DistributedMatrix) -> DataFrame:
    return matrix.cells().select("idx", "col", rounded("v"))


def mat_append_drop(spark, sf_dir):
    matrix = t.mean_matrix(spark, sf_dir)
    return matrix_cells(matrix.append_column(matrix.column(0)).drop_first_column())


def mat_concat(spark, sf_dir):
    matrix = t.mean_matrix(spark, sf_dir)
    return matrix_cells(matrix.concat(matrix.drop_first_column()))


def mat_column(spark, sf_dir):
    return t.mean_matrix(spark, sf_dir).column(3).select("idx", rounded("v"))


def mat_lastcol(spark, sf_dir):
    return t.mean_matrix(spark, sf_dir).last_column().select("idx", rounded("v"))


def mat_shape(spark, sf_dir):
    """Sizes found from the rows."""
    rows = t.mean_matrix(spark, sf_dir).rows
    matrix = DistributedMatrix.from_rows(rows)
    return rows.agg(F.count(F.lit(1)).alias("counted")).select(
        "counted", F.lit(matrix.num_rows).alias("num_rows"), F.lit(matrix.num_cols).alias("num_cols")
    )


def mat_vector(spark, sf_dir):
    """One column in index order."""
    matrix = t.mean_matrix(spark, sf_dir)
    single = DistributedMatrix.from_cells(
        matrix.cells().where("col = 4").withColumn("col", F.lit(0)), matrix.num_rows, 1
    )
    return single.to_vector().select("idx", rounded("v"))


def mat_dense(spark, sf_dir):
    """Dense rows in index order; cells that were never stored are 0."""
    matrix = DistributedMatrix.from_cells(
        t.mean_cells(spark, sf_dir).where("v > 0"), t.EMBEDDING_SIZE, t.EMBEDDING_LABELS
    )
    return matrix.to_dense().select("idx", F.posexplode("row").alias("col", "v")).select(
        "idx", "col", rounded("v")
    )


def mat_gram(spark, sf_dir):
    return t.mean_matrix(spark, sf_dir).gram().select("i", "j", rounded("v"))


def vec_mat(spark, sf_dir):
    matrix = t.mean_matrix(spark, sf_dir)
    return matrix.left_multiply(t.ramp(spark, t.EMBEDDING_SIZE)).select("col", rounded("v"))


def mat_vec(spark, sf_dir):
    matrix = t.mean_matrix(spark, sf_dir)
    return matrix.right_multiply([0.5 * c for c in range(matrix.num_cols)]).select("idx", rounded("v"))


# Training


def two_loop_direction(spark, sf_dir):
    """Two pairs made of label means: changes s, gradient changes 2 s + 0.1 m."""
    matrix = t.mean_matrix(spark, sf_dir)
    m = [F.get("row", F.lit(c)) for c in range(5)]
    s1, s2 = m[1] - m[0], m[3] - m[2]
    shape = (matrix.num_rows, 2)
    changes = DistributedMatrix(matrix.rows.select("idx", F.array(s1, s2).alias("row")), *shape)
    gradient_changes = DistributedMatrix(
        matrix.rows.select("idx", F.array(2 * s1 + 0.1 * m[4], 2 * s2 + 0.1 * m[4]).alias("row")),
        *shape,
    )
    direction = descent_direction(changes, gradient_changes, matrix.column(4))
    return direction.select("idx", rounded("v"))


def armijo_grid(spark, sf_dir):
    """The objective at nine step lengths from zero along minus the gradient."""
    examples = parallel(spark, t.line_examples(spark, sf_dir, scale=10.0))
    zero = initial_weights(spark, 4)
    direction = vectors.scal(-0.5, gradient(examples, zero, reg=0.01))
    steps = [2.0**-k for k in range(9)]
    evaluation = Evaluation(BroadcastScores(examples), LOGISTIC)
    grid = losses_at_steps(evaluation, zero, direction, 0.01, steps)
    return grid.select("trial", "step", rounded("value"))


def armijo_step(spark, sf_dir):
    """The step that the search accepts, for three scales of the features."""
    found = []
    for scale in (1.0, 10.0, 100.0):
        examples = parallel(spark, t.line_examples(spark, sf_dir, scale))
        model = fit(examples, num_iters=2)
        found.append(model.trace.where("iter = 1").select(F.lit(scale).alias("scale"), "step", "trials"))
    return found[0].unionByName(found[1]).unionByName(found[2])


def warm_start_3(spark, sf_dir):
    examples = parallel(spark, t.line_examples(spark, sf_dir))
    return fit(examples, reg=0.1, num_iters=4).weights.select("idx", rounded("v"))


def train_trace(spark, sf_dir):
    examples = parallel(spark, t.line_examples(spark, sf_dir))
    trace = fit(examples, reg=0.1, num_iters=4).trace
    return trace.select(
        "iter", rounded("objective", 8), rounded("improvement", 8), "step", "trials",
        rounded("curvature", 8), "accepted",
    )


def curvature_pairs(spark, sf_dir):
    examples = parallel(spark, t.order_examples(spark, sf_dir))
    trace = fit(examples, reg=0.1, num_iters=4, num_corrections=2).trace
    return trace.where("iter > 0").select("iter", rounded("curvature", 8))


def train_logistic(spark, sf_dir):
    examples = parallel(spark, t.line_examples(spark, sf_dir))
    model = fit(examples, reg=0.1, num_iters=60, tol=1e-14)
    return model.weights.select("idx", rounded("v", 3))


def train_sparse(spark, sf_dir):
    examples = parallel(spark, t.order_examples(spark, sf_dir))
    model = fit(examples, reg=0.1, num_iters=60, tol=1e-14)
    return model.weights.select("idx", rounded("v", 3))


def train_joined(spark, sf_dir):
    """As ``train_sparse``, with the weights never sent whole to executors."""
    examples = t.order_examples(spark, sf_dir)
    model = fit(examples, reg=0.1, num_iters=60, tol=1e-14, broadcast_features=0)
    return model.weights.select("idx", rounded("v", 3))


# Scores and ranking


def score_test(spark, sf_dir):
    _, test = split_examples(t.embedding_examples(spark, sf_dir))
    scored = score(test, t.ramp(spark, t.EMBEDDING_SIZE), threshold=0.5)
    return scored.select("vec_id", "label", rounded("score"), "prediction")


def scored_lines(spark, sf_dir) -> DataFrame:
    """Scores of lineitem, coarse enough to have ties."""
    scored = score(t.line_examples(spark, sf_dir), t.ramp(spark, 4, -0.3))
    return scored.select("label", F.round("score", 3).alias("score"))


def auc(spark, sf_dir):
    return RankingCurve(scored_lines(spark, sf_dir)).area().select(
        rounded("auc", 8), "positives", "negatives"
    )


def auc_bands(spark, sf_dir):
    """Many distinct scores, cut into bands."""
    weights = t.ramp(spark, t.ONEHOT_FEATURES).selectExpr("idx", "v + 0.01D AS v")
    scored = score(t.order_examples(spark, sf_dir), weights)
    scored = scored.select("label", F.round("score", 6).alias("score"))
    return RankingCurve(scored, band_scores=1000).area().select(
        rounded("auc", 8), "positives", "negatives"
    )


def roc_points(spark, sf_dir):
    return RankingCurve(scored_lines(spark, sf_dir), band_scores=20).points().select(
        rounded("threshold"), rounded("fpr"), rounded("tpr")
    )


# The whole job


def end_to_end(spark, sf_dir):
    """LibSVM lines, split, training, scores and area under the curve."""
    parsed = parse_libsvm(t.embedding_lines(spark, sf_dir))
    train, test = split_examples(Examples(parsed, t.EMBEDDING_SIZE, "vec_id"))
    result = train_and_rate(parallel(spark, train), test, reg=0.1, num_iters=60, tol=1e-14)
    return result.scored.select("vec_id", "label", rounded("score", 3)).withColumn(
        "auc", F.round(F.lit(result.auc), 2)
    )


def job_two_files(spark, sf_dir):
    """From text files, one to train and one to test."""
    lines = t.embedding_lines(spark, sf_dir)
    root = Scratch(spark).root
    paths = [f"{root}/{name}" for name in ("train", "test")]
    for path, side in zip(paths, ("vec_id % 5 <> 0", "vec_id % 5 = 0")):
        lines.where(side).select("value").write.text(path)
    result = run_job(spark, *paths, reg=0.1, num_iters=60, tol=1e-14)
    return result.scored.select("label", rounded("score", 3)).withColumn("auc", F.round(F.lit(result.auc), 2))


def job_same_file(spark, sf_dir):
    """From text files, train and test path the same: a random 60/40 split."""
    path = written_lines(spark, sf_dir)
    result = run_job(spark, path, path, reg=0.1, num_iters=6)
    return result.model.weights.select("idx", "v")


QUERIES = {
    query.__name__: query
    for query in (
        libsvm_parse, libsvm_drop, libsvm_load, feature_count, examples_onehot, dense_row,
        split_counts, split_random, linear_score, linear_score_joined, score_repeated_ids, residual, log_loss,
        example_gradient, gradient_dense, gradient_short, gradient_sparse, gradient_joined,
        vec_dot, vec_axpy, vec_scal, vec_norm2, vec_plus_minus, mat_append_drop, mat_concat,
        mat_column, mat_lastcol, mat_shape, mat_vector, mat_dense, mat_gram, vec_mat, mat_vec,
        two_loop_direction, armijo_grid, armijo_step, warm_start_3, train_trace,
        curvature_pairs, train_logistic, train_sparse, train_joined, score_test, auc,
        auc_bands, roc_points, end_to_end, job_two_files, job_same_file,
    )
}
QUERIES["objective"] = objective_value
QUERIES["initial_weights"] = start_weights
