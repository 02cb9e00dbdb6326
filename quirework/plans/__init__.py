"""Queries, each on the library's operators."""
