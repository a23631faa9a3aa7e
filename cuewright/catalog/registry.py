"""Registry that pairs each Spark query with its SQL counterpart."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SQL_VIEWS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` may use the views of ``SQL_VIEWS``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def _needed(sql: str, seen: list[str], inside: tuple[str, ...] = ()) -> list[str]:
    """Views used by ``sql``, each after the views it uses itself; a view may name itself (recursion)."""
    for view, body in SQL_VIEWS.items():
        if view not in seen and view not in inside and re.search(rf"\b{view}\b", sql):
            _needed(body, seen, (*inside, view))
            seen.append(view)
    return seen


def full_sql(sql: str) -> str:
    """Prefix ``sql`` with the WITH clause of the views it uses."""
    views = _needed(sql, [])
    if not views:
        return sql
    recursive = "RECURSIVE " if any(re.search(rf"\b{v}\b", SQL_VIEWS[v]) for v in views) else ""
    ctes = ",\n".join(f"{v} AS ({SQL_VIEWS[v].strip()})" for v in views)
    if sql.lstrip().upper().startswith("WITH "):
        rest = sql.lstrip()[5:]
        return f"WITH {recursive}{ctes},\n{rest}"
    return f"WITH {recursive}{ctes}\n{sql}"
