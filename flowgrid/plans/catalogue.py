"""Registered queries and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from flowgrid.plans.views import with_views

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
_MODULES = ("trips", "roads", "tiling", "flows", "networks", "demand")


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), with DuckDB SQL over tables and views that gives the same rows."""

    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = with_views(sql)
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        import_module(f"flowgrid.plans.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
