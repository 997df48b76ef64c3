"""Input adapters and the registered queries."""

from __future__ import annotations

import importlib

MODULES = ("text_queries", "search_queries", "graph_queries", "time_queries", "store_queries", "stream_queries", "round_trips")


def load():
    """Import every query module and return (queries, check SQL, coverage)."""
    from lorekeep.plans import registry

    for name in MODULES:
        importlib.import_module(f"lorekeep.plans.{name}")
    return registry.QUERIES, registry.ORACLE, registry.COVERS
