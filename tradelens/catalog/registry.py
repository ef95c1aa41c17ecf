"""Registry of named queries and the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradelens.catalog.oracle_views import VIEWS
from tradelens.catalog.tables import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with an optional oracle."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn

    return register


def runner(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Tables(spark, sf_dir))


def _needed(text: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", text)]


def compose(sql: str) -> str:
    """Prefix the shared views that the statement names, each after the views it builds on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in _needed(VIEWS[name]):
            if dep != name:
                visit(dep)
        ordered.append(name)

    for view in _needed(sql):
        visit(view)
    body = sql.strip()
    ctes = [f"{v} AS ({VIEWS[v].strip()})" for v in ordered]
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(opening):
            return expand_rounding(opening + ",\n".join([*ctes, body[len(opening):]]))
    head = "WITH " + ",\n".join(ctes) + "\n" if ctes else ""
    return expand_rounding(head + body)


def expand_rounding(sql: str) -> str:
    """``r6(x)`` is shorthand for a double rounded to 6 digits without negative zero (also r2, r3, r4)."""
    while True:
        m = re.search(r"\br([2346])\(", sql)
        if not m:
            return sql
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        inner = sql[m.end(): i - 1]
        sql = f"{sql[:m.start()]}(round(CAST(({inner}) AS DOUBLE) + 1e-9, {m.group(1)}) + 0.0){sql[i:]}"
