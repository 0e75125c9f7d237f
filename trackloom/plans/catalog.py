"""Registered queries and their SQL equivalents, gathered from the modules of this package."""

from __future__ import annotations

from trackloom.plans.registry import ORACLES, QUERIES
from trackloom.plans import aggregates, joins, mining, partitions, scalars, sources, streams  # noqa: E402,F401  (they register)

__all__ = ["ORACLES", "QUERIES"]
