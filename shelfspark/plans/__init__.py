"""Named plans and their SQL."""

from . import alerts, discovery, housekeeping, kept, pages, prices, tables, texts  # noqa: F401  they register their queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
