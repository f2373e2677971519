"""Queries over the driver's tables, and their SQL."""

from __future__ import annotations

from . import event_queries, record_queries, spectral_queries, value_queries  # noqa: F401  (register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
