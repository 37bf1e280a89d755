"""Named queries over the test tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

import importlib
import pkgutil


def _modules() -> list:
    return [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__)]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in getattr(m, "QUERIES", {}).items()}


def oracle_sql() -> dict:
    return {k: s for m in _modules() for k, s in getattr(m, "SQL", {}).items()}
