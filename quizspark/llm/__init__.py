"""Operators for cleaning and mixing a training-text corpus.

Nothing else in the library imports this subpackage; the registered queries
are in ``quizspark.llm.queries``.
"""
