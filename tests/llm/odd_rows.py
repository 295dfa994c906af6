"""Rows and columns that operators must bear."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i * i % 977}x{i}" for i in range(40_000))
PLAIN = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix strong potions at midnight near the river"


def with_clashes(df):
    """Columns named like those that operators make."""
    names = ["id", "key", "n", "score", "token", "hub", "member", "size", "component", "words", "rank", "host", "label", "h", "at"]
    return df.select("*", *(F.lit("clash").alias(n) for n in names if n not in df.columns))
