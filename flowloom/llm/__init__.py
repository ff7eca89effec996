"""Operators of a training-data pipeline: deduplication, scoring, packing, mixing, private data, vectors.

Nothing outside this package, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
