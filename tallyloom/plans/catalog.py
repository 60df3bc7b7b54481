"""All registered queries and their oracle SQL."""

from __future__ import annotations

from tallyloom.plans import forecasting, learning, metrics, panels, prep, relational, segments, serving, stream, tuning  # noqa: F401  these register
from tallyloom.plans.registry import ORACLES, QUERIES

FLAGSHIP = "wmape_by_period"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
