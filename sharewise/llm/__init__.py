"""Operators for training data: identify, score, deduplicate, extract, hide, format, pack.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
