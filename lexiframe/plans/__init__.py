"""Registered queries of the core with their DuckDB statements."""
