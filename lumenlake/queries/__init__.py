"""Registered queries over the fixture views, each with the same question in DuckDB SQL."""

from lumenlake.queries import workflows  # noqa: F401  registers its queries
from lumenlake.queries.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
