"""Operators for building training data from large text corpora.

The subpackage stands alone: nothing else in the library imports it.
"""
