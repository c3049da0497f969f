"""Imports all modules that register queries."""

from foliate.plans import checks, decisions, documents, library, relational, reports, texts, writes  # noqa: F401
from foliate.plans.registry import FLAGSHIP, ORACLES, QUERIES  # noqa: F401
