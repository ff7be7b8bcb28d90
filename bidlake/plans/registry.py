"""All queries of the commercial jobs by name, and the same in SQL."""

from __future__ import annotations

from . import documents, feed, identity, localize, money, search, streams
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "documents", "feed", "identity", "localize", "money", "search", "streams"]
