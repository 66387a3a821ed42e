"""Operators that prepare text corpora for language-model training.

Every operator takes and returns DataFrames and has its own module. Nothing outside this folder imports it; the
registered queries and their SQL are in ``queries.py``.
"""
