"""Audit operators: DataFrame in, DataFrame out."""
