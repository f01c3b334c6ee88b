"""Operators for training-data pipelines over documents, pages and benchmarks.

Nothing else in the library imports this package; `queries.py` holds the thin
queries, `corpus_pipeline.py` at the top of the repository chains five of the
operators.
"""
