"""Imports every module that registers queries."""

from townhall.plans import details, events, extraction, feeds, matching, places, records, reports  # noqa: F401
from townhall.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
