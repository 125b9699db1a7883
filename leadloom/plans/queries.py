"""All queries of the lead engine; importing this module registers them."""

from __future__ import annotations

from . import q_analytics, q_cleaning, q_dedup, q_estimation, q_integrity, q_intel, q_pages, q_scoring, q_select, q_sources, q_streams, q_validation
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "q_analytics", "q_cleaning", "q_dedup", "q_estimation", "q_integrity", "q_intel", "q_pages", "q_scoring", "q_select", "q_sources", "q_streams", "q_validation"]
