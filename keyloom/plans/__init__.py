"""Registered queries: the operators bound to concrete tables, each beside its SQL twin."""

from __future__ import annotations

import importlib

FAMILIES = ("sources", "lifespans", "scoring", "elements", "tracks", "geometry", "events", "coverage",
            "baselines", "quality", "pipelines", "datasets")


def all_queries():
    from .registry import ORACLES, QUERIES
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
    return QUERIES, ORACLES
