"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; deleting it leaves the
rest whole.  Every operator takes and returns DataFrames and selects the
columns it needs first, so extra input columns never clash with its own.
"""
