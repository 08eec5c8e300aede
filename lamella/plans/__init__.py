"""Registered queries with their DuckDB SQL."""

from . import filter_queries, planning_queries, source_queries, spatial_queries, stream_queries  # noqa: F401  they register themselves
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
