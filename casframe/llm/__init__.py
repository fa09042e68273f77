"""Operators for large text corpora; their queries are in :mod:`casframe.llm.queries`."""
