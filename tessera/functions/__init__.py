"""Scalar functions of the query language as Column expressions."""
