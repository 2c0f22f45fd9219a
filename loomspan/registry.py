"""The registry of queries: a builder and, where SQL can express it, its DuckDB text."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, "Query"] = {}


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None


def query(sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under its own name."""

    def add(build: Builder) -> Builder:
        _QUERIES[build.__name__] = Query(build.__name__, build, sql)
        return build

    return add


def registry() -> dict[str, Query]:
    """All queries of the modules in ``loomspan.queries``."""
    from . import queries

    for module in pkgutil.iter_modules(queries.__path__):
        importlib.import_module(f"{queries.__name__}.{module.name}")
    return dict(_QUERIES)
