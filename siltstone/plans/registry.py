"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from siltstone.plans import adjudication, drivers, evidence, graphs, joins, metrics, profiles, scores, statistics, typed  # noqa: F401  they register themselves
from siltstone.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
