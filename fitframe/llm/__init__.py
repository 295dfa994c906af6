"""Operators for preparing text corpora on Spark.

Nothing else in the package imports this subpackage. Every operator takes and
returns DataFrames; the queries over the standard tables are in ``queries``.
"""
