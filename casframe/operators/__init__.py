"""Relational operators of the storage model."""
