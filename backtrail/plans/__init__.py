"""Queries made of the operators, with their DuckDB counterparts."""
