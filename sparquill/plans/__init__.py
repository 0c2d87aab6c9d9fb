"""Queries of the library's own operators, with SQL twins."""

from __future__ import annotations

import importlib

MODULES = ("search", "ranking", "keywords", "identifiers", "graph", "graph_search", "rules", "validation", "mining", "learned", "nested", "inspection", "more", "repairs", "variants", "capabilities", "subgraphs", "directories", "parties", "vectors")


def _all(kind: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"{__name__}.{name}"), kind)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
