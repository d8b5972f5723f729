"""Listening analytics as Spark plans."""
