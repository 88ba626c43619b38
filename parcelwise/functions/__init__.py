"""Scalar column expressions (built-in Spark functions) and tiny numeric helpers."""
