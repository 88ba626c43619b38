"""Readers: driver tables, the derived order fixture, CSV/Parquet round trips."""
