"""Operators of a large-scale training-data pipeline.

Nothing outside this folder imports it.  Every operator takes and returns DataFrames,
names its own columns and ignores columns it was not told about.
"""
