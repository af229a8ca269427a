"""Registered queries: library operators applied to the given tables."""

from __future__ import annotations

from importlib import import_module

from .registry import Query

FAMILIES = ["quality", "panel", "history", "discourse", "evaluation", "modeling", "anomalies", "decomposition"]


def all_queries() -> list[Query]:
    out: list[Query] = []
    for family in FAMILIES:
        out += import_module(f"{__name__}.{family}").FAMILY.items
    names = [q.name for q in out]
    assert len(names) == len(set(names)), "query names repeat"
    return out
