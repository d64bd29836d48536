"""Chain-shaped views of the star-schema test tables, and DuckDB oracles."""
