"""Operators for large text corpora and the corpus pipeline's building blocks.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
