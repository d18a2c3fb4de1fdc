"""Operators for preparing training data at scale."""
