"""Queries over the shared tables, one for each operator, by family."""
