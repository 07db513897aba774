"""All registered queries."""

from . import catalog_queries, container_queries, deepzoom_queries, level_queries, metadata_queries, multiplex_queries, region_queries, rule_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
