"""Examples and vectors built from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fitframe import (
    DistributedMatrix,
    Examples,
    examples_from_array,
    examples_from_arrays,
    examples_from_columns,
)

# Fixed values of the source tables.
EMBEDDING_SIZE = 64
EMBEDDING_LABELS = 10
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
ONEHOT_FEATURES = 36  # price, 5 priorities, 5 segments, 25 nations


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def embedding_examples(spark: SparkSession, sf_dir: str) -> Examples:
    """Dense, 64 features; label 1 for the upper five classes."""
    return examples_from_array(
        read(spark, sf_dir, "embeddings"),
        F.col("label") >= 5,
        F.col("embedding"),
        EMBEDDING_SIZE,
        id_col="vec_id",
    )


def embedding_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, value)``: the embeddings as LibSVM text, untidy on purpose.

    Labels -1, 0, 1, 2; doubled and leading blanks; text behind a second colon;
    and for every tenth vector a comment and a blank line besides.
    """
    embeddings = read(spark, sf_dir, "embeddings")
    negative = "if(vec_id % 2 = 0, '-1', '0')"
    positive = "if(vec_id % 2 = 0, '1', '2')"
    items = "transform(embedding, (v, i) -> concat(i + 1, ':', cast(v AS double)))"
    lines = embeddings.selectExpr(
        "vec_id",
        f"""concat(if(vec_id % 5 = 0, '   ', ''),
                   if(label >= 5, {positive}, {negative}),
                   ' ',
                   array_join({items}, if(vec_id % 3 = 0, '  ', ' ')),
                   if(vec_id % 7 = 0, ':note', '')) AS value""",
    )
    every_tenth = embeddings.where("vec_id % 10 = 0")
    comments = every_tenth.selectExpr("vec_id", "concat('# vector ', vec_id) AS value")
    blanks = every_tenth.selectExpr("vec_id", "'   ' AS value")
    return lines.unionByName(comments).unionByName(blanks)


def order_examples(spark: SparkSession, sf_dir: str) -> Examples:
    """Sparse: scaled price and one-hot priority, segment and nation."""
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    segment = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment"))
    priority = F.substring("o_orderpriority", 1, 1).cast("int")
    return examples_from_arrays(
        joined,
        F.col("o_orderstatus") == "F",
        F.array(F.lit(0), priority, segment.cast("int") + 5, F.col("c_nationkey") + 11),
        F.array(F.col("o_totalprice") / 500000, F.lit(1.0), F.lit(1.0), F.lit(1.0)),
        ONEHOT_FEATURES,
        id_col="o_orderkey",
    )


def line_examples(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> Examples:
    """Dense, 4 features; label 1 for returned lines."""
    columns = [
        F.col("l_quantity") / 50,
        F.col("l_extendedprice") / 1e5,
        F.col("l_discount"),
        F.col("l_tax"),
    ]
    return examples_from_columns(
        read(spark, sf_dir, "lineitem"),
        F.col("l_returnflag") == "R",
        [c * F.lit(scale) for c in columns],
    )


def ramp(spark: SparkSession, num_features: int, slope: float = 0.01) -> DataFrame:
    """``(idx, v)`` with v = slope * idx."""
    return spark.range(num_features).select(
        F.col("id").cast("int").alias("idx"), (F.col("id") * F.lit(slope)).alias("v")
    )


def mean_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(idx, col, v)``: the mean embedding per label, one column per label."""
    cells = read(spark, sf_dir, "embeddings").select(
        F.col("label").alias("col"), F.posexplode("embedding").alias("idx", "x")
    )
    return cells.groupBy("idx", "col").agg(F.avg(F.col("x").cast("double")).alias("v"))


def mean_vector(spark: SparkSession, sf_dir: str, label: int) -> DataFrame:
    return mean_cells(spark, sf_dir).where(F.col("col") == label).select("idx", "v")


def mean_matrix(spark: SparkSession, sf_dir: str) -> DistributedMatrix:
    return DistributedMatrix.from_cells(
        mean_cells(spark, sf_dir), EMBEDDING_SIZE, EMBEDDING_LABELS
    )
