"""Query registry: name -> Spark callable (spark, sf_dir) -> DataFrame, plus
the equivalent DuckDB SQL where the result is SQL-expressible.

Modules under ``retainlab.plans`` register their queries with ``@query``;
``all_queries()`` imports them all.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retainlab.plans.oracle_fixtures import with_fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}

MODULES = (
    "retainlab.plans.q_sources",
    "retainlab.plans.q_prepare",
    "retainlab.plans.q_evaluate",
    "retainlab.plans.q_diversity",
    "retainlab.plans.q_calibrate",
    "retainlab.plans.q_neighbours",
    "retainlab.plans.q_portfolio",
    "retainlab.plans.q_models",
    "retainlab.plans.q_trees",
    "retainlab.plans.q_serving",
    "retainlab.plans.q_stream",
)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the DuckDB body run after the fixture CTEs."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = with_fixtures(sql)
        return fn

    return deco


def _load() -> None:
    for m in MODULES:
        importlib.import_module(m)


def all_queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def all_oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
