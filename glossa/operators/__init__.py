"""Operators: building a dictionary and querying it in batches."""
