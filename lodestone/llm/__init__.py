"""Operators for building language-model training corpora.

Nothing else in the package imports this subpackage.  Every operator is a function from
DataFrames to a DataFrame; ``queries`` holds the thin registered queries.
"""
