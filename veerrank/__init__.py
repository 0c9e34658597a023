"""Dual-intent retrieval analytics and training-text operators on Spark."""
