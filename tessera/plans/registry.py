"""All queries over the reference's own operators, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("scalars", "blocks", "streams", "containers", "headers", "planes", "measures", "syntax", "tiles", "elements", "transforms")
_FOUND: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (session, folder) -> rows, with SQL that gives the same rows where there is some."""

    def keep(function: Query) -> Query:
        if name in _FOUND:
            raise ValueError(f"two queries are called {name}")
        _FOUND[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return keep


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tessera.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
