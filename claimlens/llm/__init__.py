"""Operators for large-scale training-data pipelines.

Nothing else in the package imports this subpackage.  Every operator module
has a general function over DataFrames; ``queries.py`` holds the thin
``opN_<name>`` queries over the test tables.
"""
