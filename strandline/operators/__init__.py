"""Operators on fact tables; each takes and returns DataFrames."""
