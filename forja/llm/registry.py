"""The queries of this package and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

import importlib
import pkgutil

import forja.llm as package

QUERIES = {}
ORACLES = {}


def register(sql: str | None = None):
    """Decorator: register a query under its function's name."""

    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


def load() -> None:
    """Import every operator module (``opN_…``), which registers its query."""
    for info in pkgutil.iter_modules(package.__path__):
        if info.name.startswith("op"):
            importlib.import_module(f"{package.__name__}.{info.name}")
