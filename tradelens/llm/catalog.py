"""Loads the modules that register queries of this subpackage."""

from __future__ import annotations

import importlib
import pkgutil

import tradelens.llm as package
from tradelens.llm.registry import ORACLES, QUERIES

for _module in pkgutil.iter_modules(package.__path__):
    if _module.name.startswith("q_"):
        importlib.import_module(f"{package.__name__}.{_module.name}")

__all__ = ["ORACLES", "QUERIES"]
