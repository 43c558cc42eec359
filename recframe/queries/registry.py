"""Collects every registered query and oracle statement."""

from __future__ import annotations

import importlib

from recframe.queries.common import REGISTRY

_FAMILIES = ["labels", "filters", "ranking", "encoders", "monitoring", "experiments", "feedback", "vectors", "streaming", "misc", "io", "models"]


def all_queries() -> dict:
    for fam in _FAMILIES:
        importlib.import_module(f"recframe.queries.q_{fam}")
    return dict(REGISTRY)


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for fam in _FAMILIES:
        out.update(importlib.import_module(f"recframe.queries.sql_{fam}").SQL)
    return out
