"""Queries over the driver's tables: each operator with stand-in inputs, and its SQL twin."""
