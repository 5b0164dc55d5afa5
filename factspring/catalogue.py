"""Every registered query of the fact engine with its SQL oracle."""

from __future__ import annotations

from .plans import benchmarks, calculation, calls, chapters, checks, documents, forms, grids, identities, metrics, network, operations, prose, reading, relational, schedules, selection, sheets, structure, titles, upkeep, words, work  # noqa: F401  register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
