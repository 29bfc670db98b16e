"""All queries over the reference operators, and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} exists already")
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from importlib import import_module
    from pkgutil import iter_modules

    from tracewell import plans

    for module in iter_modules(plans.__path__):
        if module.name.startswith("q_"):
            import_module(f"tracewell.plans.{module.name}")


load()
