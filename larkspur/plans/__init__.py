"""Registered queries over the driver's tables."""

from larkspur.plans import boards, captured, counts, events, files, grouping, health, houses, ledger, matches, named, persisted, prices, repairs, scans, streams  # noqa: F401  they register themselves
from larkspur.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
