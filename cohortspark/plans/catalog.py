"""All registered queries; importing the query modules fills the registry."""

from __future__ import annotations

from . import cohort_queries, panel_queries, score_queries, source_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
