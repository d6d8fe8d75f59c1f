"""Every registered query of the library, with the SQL it is compared with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: Modules of this package that hold a REGISTRY of queries (name -> function of session and folder) and their SQL.
MODULES = ["frame_queries", "scalar_queries", "function_queries", "geo_queries", "shape_queries", "stream_queries"]


def _modules():
    return [importlib.import_module(f"loxodrome.plans.{name}") for name in MODULES]


def queries() -> dict[str, Callable]:
    return {k: v for m in _modules() for k, v in m.REGISTRY.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.REGISTRY.sql.items()}
