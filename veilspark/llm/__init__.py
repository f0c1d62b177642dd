"""Operators that prepare text for language-model training.

Nothing outside this folder imports it, apart from the query registry and
``corpus_pipeline.py`` at the top of the repository.
"""
