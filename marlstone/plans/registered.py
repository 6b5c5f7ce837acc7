"""All registered queries of the engine."""

from marlstone.plans import bounds, cases, derived, queries, reading, sources
from marlstone.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "bounds", "cases", "derived", "queries", "reading", "sources"]
