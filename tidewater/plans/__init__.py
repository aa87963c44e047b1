"""Registered query plans and their DuckDB counterparts."""
