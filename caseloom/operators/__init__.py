"""Table-level operators: DataFrames in, DataFrames out.

They are lazy, but for two bounded steps: the sketch of hot keys on large tables, and
the few hits of a search, which are written once.
"""
