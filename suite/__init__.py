"""Registered queries: each pairs a DataFrame plan with the SQL that must give the same rows."""

from __future__ import annotations

import importlib

_MODULES = ("expressions", "semantic", "profiles", "texts", "search", "log", "agents", "streams", "knowledge")


def all_queries() -> tuple[dict, dict]:
    """Queries and SQL of all modules, by key."""
    from suite.registry import ORACLES, QUERIES

    for name in _MODULES:
        importlib.import_module(f"suite.{name}")
    return QUERIES, ORACLES
