"""Operators for large training-text corpora, each one a ``DataFrame -> DataFrame`` function."""
