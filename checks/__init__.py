"""Queries over the driver tables, each with an independent SQL statement of the same result."""

from __future__ import annotations

import importlib

MODULES = ["pixels", "events", "retrieval", "alerting", "streams"]


def load():
    """(queries, SQL) of all modules."""
    for name in MODULES:
        importlib.import_module(f"checks.{name}")
    from checks.registry import ORACLES, QUERIES
    return QUERIES, ORACLES
