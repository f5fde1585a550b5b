"""Operators of a training-data pipeline on Spark.

Nothing else in the package imports this subpackage. Every operator takes and
returns DataFrames, reads only the columns it is told to read, and names its
defined results for nulls, empty texts, ties and empty tables in its docstring.
"""
