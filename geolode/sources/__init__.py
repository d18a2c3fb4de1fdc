"""Readers and writers of the file formats."""
