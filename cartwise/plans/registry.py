"""Registry of named queries: a Spark builder and, where SQL can state it, a DuckDB oracle.

Each builder takes (spark, sf_dir) and returns a DataFrame over the whole driver
tables. Computed columns carry the same alias on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    oracle: str | None
    inventory: str  # SURVEY section 2 ids covered


_REGISTRY: dict[str, Query] = {}


def register(name: str, inventory: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Query(name, fn, oracle, inventory)
        return fn
    return deco


def all_queries() -> dict[str, Query]:
    # Importing the catalogue modules fills the registry.
    from cartwise.plans import (q_baskets, q_churn, q_dashboard, q_load,  # noqa: F401
                                q_pull)
    return dict(_REGISTRY)
