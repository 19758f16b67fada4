"""Registered queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.plans.oracle_views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _needed(sql: str, found: list[str]) -> list[str]:
    """Views named in a SQL text, dependencies first."""
    for name in VIEWS:
        if name not in found and VIEWS[name] is not sql and re.search(rf"\b{name}\b", sql):
            _needed(VIEWS[name], found)
            if name not in found:
                found.append(name)
    return found


def oracle(sql: str) -> str:
    """Complete SQL: the named views as common table expressions, then the query."""
    body = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql.strip(), flags=re.I)
    has_ctes = body != sql.strip()
    views = [
        f"{v} AS ({VIEWS[v][10:]})" if VIEWS[v].startswith("RECURSIVE ") else f"{v} AS MATERIALIZED ({VIEWS[v]})"
        for v in _needed(sql, [])
    ]
    if not views:
        return f"WITH RECURSIVE {body}" if has_ctes else body
    return "WITH RECURSIVE " + ",\n".join(views) + (",\n" if has_ctes else "\n") + body


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return add
