"""Incremental versions of the mergeable aggregates."""
