"""Every query by name, with the SQL that must give the same rows."""

from __future__ import annotations

from quillon.plans import algebra, coverage, learning, rows  # noqa: F401  they register their queries
from quillon.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
