"""Queries registered for the driver. Each reads the given tables whole; most have an equivalent SQL text."""

from .base import QUERIES, SQL
from . import columns, gaps, quality, rows, stats, whole  # noqa: F401  (importing registers)

__all__ = ["QUERIES", "SQL"]
