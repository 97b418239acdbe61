"""All named queries of the library and the SQL that must give the same rows."""

from __future__ import annotations

from . import feed_queries, relational_queries, search_queries, service_queries, stream_queries, text_queries, trust_queries
from .base import ORACLES, QUERIES

MODULES = (feed_queries, relational_queries, search_queries, service_queries, stream_queries, text_queries, trust_queries)
QUERIES["near_duplicate_pairs"] = search_queries.near_duplicate_pairs
FLAGSHIP = search_queries.near_duplicate_pairs
__all__ = ["FLAGSHIP", "MODULES", "ORACLES", "QUERIES"]
