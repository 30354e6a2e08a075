"""Operators that prepare text corpora for model training.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
