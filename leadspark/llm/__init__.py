"""Operators of a training-data pipeline over `documents`, `pages` and `benchmark`.

Nothing else in the library imports this package. Every operator takes and returns DataFrames; the
queries that apply them to whole tables are in `queries.py`.
"""
