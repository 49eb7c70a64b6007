"""Registered queries over the driver tables."""

from __future__ import annotations

import importlib

_MODULES = (
    "q_ingest",
    "q_search",
    "q_scalar",
    "q_resolve",
    "q_graph",
    "q_pages",
    "q_ground",
    "q_events",
    "q_context",
    "q_records",
)


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"sparkfolio.plans.{name}")


def all_queries():
    from sparkfolio.plans.registry import QUERIES

    _load()
    return QUERIES


def all_oracles():
    from sparkfolio.plans.registry import ORACLES

    _load()
    return ORACLES
