"""Queries over the test tables."""

from . import queries, details, engine_queries, source_queries, trained_queries, storage_queries  # noqa: F401, I001
