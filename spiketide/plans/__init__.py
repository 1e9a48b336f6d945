"""Recordings as named tables, and the tables that stand for them in tests and benchmarks."""
