"""Registered queries: each applies operators to the test tables, most with an oracle text."""

from __future__ import annotations

import importlib

MODULES = ("windows", "screener", "models", "feeds", "waves", "stores", "desk", "profiles", "chains", "sequences", "rotations")


def load() -> tuple[dict, dict]:
    """Fresh copies of the query and oracle tables."""
    from . import registry

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLE_SQL)
