"""All registered queries."""

from __future__ import annotations

from . import request_queries, search, search_queries, service_queries, text_queries  # noqa: F401  (they register themselves)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
