"""Query registry: a Spark builder per name, with its checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

BUILDERS: dict[str, Builder] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder; ``check`` is equivalent SQL over the same tables."""

    def add(fn: Builder) -> Builder:
        if name in BUILDERS:
            raise ValueError(f"query {name!r} registered twice")
        BUILDERS[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return add
