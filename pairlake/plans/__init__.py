"""Registered queries: the given tables recast as this package's tables, plus DuckDB oracles."""
