"""Queries over the driver's tables with their SQL, by subject."""

from __future__ import annotations

from tallysheet.plans import coverage, linkage, overview, quality, reports, results, store, texts  # noqa: F401
from tallysheet.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
