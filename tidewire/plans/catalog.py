"""All registered queries of the engine."""

from __future__ import annotations

from tidewire.plans import crawl_queries, dedup_queries, desk_queries, discovery_queries, feed_queries, page_queries, url_queries, write_queries  # noqa: F401
from tidewire.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
