"""Registered queries over the test tables, each with its DuckDB twin where SQL can express it."""
