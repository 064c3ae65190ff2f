"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from tidewatch.plans import registry

MODULES = [
    "feature_queries",
    "dataset_queries",
    "evaluation_queries",
    "portfolio_queries",
    "raw_queries",
    "monitor_queries",
    "operations_queries",
    "source_queries",
    "model_queries",
]


def _load() -> None:
    for m in MODULES:
        import_module(f"tidewatch.plans.{m}")


def builders() -> dict[str, registry.Builder]:
    _load()
    return dict(registry.BUILDERS)


def checks() -> dict[str, str]:
    _load()
    return dict(registry.CHECKS)
