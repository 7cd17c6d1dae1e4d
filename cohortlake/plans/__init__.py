"""Registered queries over the supplied tables, each beside its DuckDB statement."""
