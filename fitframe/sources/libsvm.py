"""LibSVM text: ``label index:value index:value ...`` with 1-based indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fitframe.examples import Examples

# Fixed values of the text format.
COMMENT_MARK = "#"
ITEM_SEPARATOR = " "
PAIR_SEPARATOR = ":"
BLANKS = "".join(chr(code) for code in range(33))  # trimmed off both ends of a line


def binary_label(label: Column) -> Column:
    """0.0 for labels at or below zero, 1.0 for all others (NaN included)."""
    return F.when(label <= 0, F.lit(0.0)).otherwise(F.lit(1.0))


def parse_libsvm(lines: DataFrame, column: str = "value", mode: str = "failfast") -> DataFrame:
    """Replace a text column by ``label, indices, values``; keep the others.

    Blank lines and lines that start with ``#`` are dropped. A line with a bad
    label, index or value fails the job that reads it (``mode='failfast'``) or
    is left out (``mode='drop'``).
    """
    if mode not in ("failfast", "drop"):
        raise ValueError(f"mode must be 'failfast' or 'drop', not {mode!r}")
    kept = [c for c in lines.columns if c != column]
    trimmed = lines.select(*kept, F.btrim(F.col(column), F.lit(BLANKS)).alias("_line"))
    items = f"split(_line, '{ITEM_SEPARATOR}')"
    pairs = f"filter(slice({items}, 2, size({items})), item -> item <> '')"
    tokens = trimmed.where(f"_line <> '' AND NOT startswith(_line, '{COMMENT_MARK}')").selectExpr(
        *kept,
        f"{items}[0] AS _label",
        f"transform({pairs}, item -> split(item, '{PAIR_SEPARATOR}')) AS _pairs",
    )

    label = "try_cast(_label AS double)"
    index = "try_cast(get(p, 0) AS int)"
    value = "try_cast(get(p, 1) AS double)"
    if mode == "failfast":
        label = _or_fail(label, "double", "label", "_label")
        index = _or_fail(f"if({index} >= 1, {index}, NULL)", "int", "item", "array_join(p, ':')")
        value = _or_fail(value, "double", "item", "array_join(p, ':')")
    parsed = tokens.selectExpr(
        *kept,
        f"{label} AS _label",
        f"transform(_pairs, p -> {index} - 1) AS indices",
        f"transform(_pairs, p -> {value}) AS values",
    )
    if mode == "drop":
        parsed = parsed.where(
            """_label IS NOT NULL AND forall(indices, i -> coalesce(i >= 0, false))
               AND forall(values, v -> v IS NOT NULL)"""
        )
    return parsed.select(*kept, binary_label(F.col("_label")).alias("label"), "indices", "values")


def _or_fail(expression: str, type_name: str, what: str, text: str) -> str:
    failure = f"raise_error(concat('not a LibSVM {what}: ', {text}))"
    return f"coalesce({expression}, cast({failure} AS {type_name}))"


def infer_num_features(parsed: DataFrame) -> int:
    """Largest index plus one; a row without entries counts as index 0."""
    return num_features_frame(parsed).first()["num_features"]


def num_features_frame(parsed: DataFrame) -> DataFrame:
    top = F.coalesce(F.array_max("indices"), F.lit(0))
    return parsed.agg((F.coalesce(F.max(top), F.lit(-1)) + 1).alias("num_features"))


def read_libsvm(
    spark: SparkSession,
    path: str,
    num_features: int | None = None,
    num_partitions: int | None = None,
    mode: str = "failfast",
) -> Examples:
    """Load examples from LibSVM files.

    Without ``num_features`` one pass over the text finds it. The text splits
    by ``spark.sql.files.maxPartitionBytes``; ``num_partitions`` forces a count.
    """
    lines = spark.read.text(path)
    if num_partitions is not None:
        lines = lines.repartition(num_partitions)
    parsed = parse_libsvm(lines, mode=mode)
    if num_features is None or num_features <= 0:
        num_features = infer_num_features(parsed)
    return Examples(parsed, num_features)
