"""Query catalogue: named queries over the supplied tables and their DuckDB equivalents."""
