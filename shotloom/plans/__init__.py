"""Query registry: named jobs over the driver tables plus their DuckDB oracles."""
