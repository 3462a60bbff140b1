"""Registered queries: every operator run over whole tables, with its SQL check."""

from __future__ import annotations

from importlib import import_module

from omenlog.plans.registry import REGISTRY, Query

MODULES = (
    "detection", "leadtime", "alerting", "temporal", "quality", "scores", "splits",
    "text", "surprise", "vectors", "reports", "synthetic", "streams",
)


def load() -> dict[str, Query]:
    """All registered queries by name."""
    for module in MODULES:
        import_module(f"omenlog.plans.{module}")
    return dict(REGISTRY)
