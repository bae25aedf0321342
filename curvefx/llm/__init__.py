"""Operators for preparing training text, each a Spark job over whole tables."""
