"""Operators for preparing training corpora.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` at the top
of the repository and the guarded block of ``__spark_entry__.py`` are its only
callers.
"""
