"""Operators of a training-data pipeline: one module per operator, free of the rest of the library.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
