"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

import importlib

#: Modules that register queries.
MODULES = ("market", "lag", "trading", "text", "health")


def load() -> tuple[dict, dict]:
    """All queries by name, and the SQL of those that have it."""
    from . import domain

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return domain.QUERIES, domain.SQL
