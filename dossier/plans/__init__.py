"""Registered queries: the operators bound to the given tables, each with its SQL."""
