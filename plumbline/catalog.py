"""Queries of the core library and the SQL that checks them."""

from __future__ import annotations

from plumbline.plans import frame_queries, more_queries, report_queries  # noqa: F401  (register their queries)
from plumbline.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
