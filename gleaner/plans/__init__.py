"""Queries and commit jobs composed from the operators."""
