"""Operators for preparing training data, one module each.

Every operator takes and returns DataFrames.  Nothing outside this folder
(and ``corpus_pipeline.py``) imports it.
"""
