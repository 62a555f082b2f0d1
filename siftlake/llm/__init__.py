"""Operators for preparing language-model training text (optional subpackage).

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; ``registry`` binds them to the benchmark tables.
"""
