"""Registered queries and their DuckDB counterparts over the driver tables."""
