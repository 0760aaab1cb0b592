"""All registered queries with their reference SQL."""

from __future__ import annotations

from eventloom.plans import event_queries, export_queries, function_queries, index_queries, other_queries, schema_queries  # noqa: F401  they register themselves
from eventloom.plans.registry import ORACLE, QUERIES

FLAGSHIP = "m0_filtered_volume"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
