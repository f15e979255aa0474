"""Operators for preparing language-model training data at cluster scale.

Nothing outside this subpackage imports it. Every operator takes a DataFrame and the names of the
columns to use, ignores all other columns, and states in its docstring what it does with nulls,
empty and very long texts, ties, repeated rows and empty tables.
"""
