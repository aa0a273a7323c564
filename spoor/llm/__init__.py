"""Operators of a training-data pipeline. Nothing outside of this package and corpus_pipeline.py imports it."""
