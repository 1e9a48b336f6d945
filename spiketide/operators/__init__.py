"""Operators on spike, stimulus and cell tables; each takes and returns DataFrames and stays lazy."""
