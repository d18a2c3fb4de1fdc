"""DataFrame operators: each takes and returns DataFrames or columns."""
