"""Registered queries, one module per operator family."""

from __future__ import annotations

import importlib

FAMILIES = ["core_queries", "stats_queries", "sequence_queries", "rules_queries", "intel_queries", "stream_queries",
            "model_queries"]


def load_all() -> None:
    for name in FAMILIES:
        importlib.import_module(f"wayfold.plans.{name}")
