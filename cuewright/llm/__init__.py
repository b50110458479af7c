"""Operators for making language-model training data out of large document tables.

Nothing else in the library imports this package. Functions sent to Python workers live in modules
that register themselves to be pickled by value, so executors need no copy of the package.
"""
