"""Registry of named queries: Spark builder + optional DuckDB oracle SQL.

A query is ``fn(spark, sf_dir) -> DataFrame``. The oracle, when given, is
ANSI SQL over the raw driver tables (``v_*`` views are expanded by
``plans.oracle.with_views``) with the same column names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .oracle import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    oracle: str | None
    ops: tuple[str, ...]  # SURVEY section-2 operator ids covered


REGISTRY: dict[str, Query] = {}


def register(name: str, ops: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, with_views(oracle) if oracle else None,
                               tuple(o.strip() for o in ops.split(",") if o.strip()))
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules registers their queries
    from . import (queries_activity, queries_core, queries_inventory, queries_reco,  # noqa: F401
                   queries_search, queries_streaming)
    return REGISTRY
