"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
and column names, reads only those columns, and returns its own columns, so
extra input columns (clashing names included) never reach a plan.
"""
