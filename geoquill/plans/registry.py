"""Registered queries and their SQL, gathered from the query modules of this package."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from geoquill.plans.fixtures import oracle, table

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
MODULES = ("metrics", "labels", "space", "splits", "raster", "flows", "tables")


def query(name: str, sql: str | None = None) -> Callable:
    """Registers build(t) under a name; t(view) gives a table of the data."""

    def put(build: Callable) -> Callable:
        assert name not in _QUERIES, name
        _QUERIES[name] = lambda spark, sf_dir: build(lambda view: table(spark, sf_dir, view))
        if sql:
            _SQL[name] = oracle(sql)
        return build

    return put


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"geoquill.plans.{module}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
