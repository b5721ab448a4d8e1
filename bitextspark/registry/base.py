"""Registration of queries and composition of the SQL side from named views."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}
_SQL: dict[str, tuple[str, tuple[str, ...]]] = {}

SECTIONS = (
    "rows", "tasks", "bilingual", "vocabulary", "batches", "sources", "evaluation", "text", "iterative", "stateful", "build", "examples",
)


def view(name: str, sql: str, *needs: str) -> None:
    if name in VIEWS:
        raise ValueError(f"view {name} is defined twice")
    VIEWS[name] = (needs, sql)


def compose(sql: str, needs: tuple[str, ...]) -> str:
    """Prefix `sql` with the WITH list of the views it needs, dependencies first."""
    order: dict[str, None] = {}
    open_views = list(reversed(needs))
    while open_views:
        name = open_views[-1]
        missing = [n for n in VIEWS[name][0] if n not in order]
        if name in order or not missing:
            order[open_views.pop()] = None
        else:
            open_views += reversed(missing)
    if not order:
        return sql
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order) + "\n" + sql


def query(name: str, sql: str | None = None, *needs: str):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = (sql, needs)
        return fn

    return register


def load_all() -> None:
    for section in SECTIONS:
        importlib.import_module(f"bitextspark.registry.{section}")
    ORACLES.update({name: compose(sql, needs) for name, (sql, needs) in _SQL.items()})
