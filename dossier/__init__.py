"""Audit of business document packages with PySpark."""
