"""Composite pipelines, query registry and oracle SQL."""
