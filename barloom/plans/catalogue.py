"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

from barloom.plans.registry import REGISTRY, Query

MODULES = [
    "factor_queries",
    "cleaning_queries",
    "quality_queries",
    "crosssection_queries",
    "serving_queries",
    "learning_queries",
    "strategy_queries",
    "source_queries",
]


def load() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"barloom.plans.{module}")
    return dict(REGISTRY)
