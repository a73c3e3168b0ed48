"""Operators for building training corpora from documents and web pages.

Nothing else in the library imports this package; ``queries`` binds each
operator to the given tables.
"""
