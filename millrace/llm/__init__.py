"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Every operator takes and returns
DataFrames, keeps results whole, and materialises intermediate tables only in the folder
named by ``spark.checkpoint.dir``.
"""
