"""Named queries over the given tables, each with its SQL oracle where one is practical."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _load():
    from tradelens.catalog import registry

    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
    return registry


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registry = _load()
    return {name: registry.runner(fn) for name, fn in registry.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_load().ORACLES)
