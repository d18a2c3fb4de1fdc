"""Queries put together from the operators, with their checking SQL."""
