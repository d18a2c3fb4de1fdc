"""Column functions: quantisation, grid keys, projection, predicates."""
