"""Registered queries: each runs on the given tables and, where SQL can say it, has a SQL twin."""

from __future__ import annotations

from flowtables.queries import events, graphs, lineage, loading, registry_queries, replays, runs, tables, text, time  # noqa: F401  they register themselves
from flowtables.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
