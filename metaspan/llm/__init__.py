"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; the thin ``opN_`` queries are in :mod:`metaspan.llm.queries`.
"""
