"""Registered queries with their SQL counterparts."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    """Import every module of queries, which registers them."""
    for info in pkgutil.iter_modules(__path__):
        if info.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{info.name}")
