"""Board queries and the registry of named queries."""

from gradeloom.plans.registry import ORACLES, QUERIES
from gradeloom.plans import table_queries, basic_queries, view_queries, text_queries, store_queries  # noqa: F401  (fill the registry)

__all__ = ["ORACLES", "QUERIES"]
