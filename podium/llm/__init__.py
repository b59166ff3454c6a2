"""Operators for preparing training data: one module per operator, plus the shared helpers.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
