"""Registered queries: each module fills ``QUERIES`` (name to callable) and ``SQL`` (name to the same result in DuckDB)."""
