"""Operators: each takes DataFrames and returns DataFrames, nothing is collected but rule lists."""
