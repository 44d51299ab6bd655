"""Binding of the star-schema test tables to the run logs, and the registered queries with their SQL."""

from __future__ import annotations

import importlib

AREAS = ("base", "facts", "study", "ops", "text", "stream", "read")


def all_queries():
    """Load every area and return the registered queries and their SQL."""
    from trialscape.mart import registry

    for area in AREAS:
        importlib.import_module(f"trialscape.mart.q_{area}")
    return registry.QUERIES, {name: registry.with_ctes(sql) for name, sql in registry.SQL.items()}
