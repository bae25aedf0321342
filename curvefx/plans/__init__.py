"""Queries over the driver's tables, each with its SQL twin where SQL can express it."""
