"""All queries of the library: each operator applied to the given tables, with its SQL where there is one."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("spatial", "tables", "retrieval", "logs", "analysis", "flows", "records", "context")


def _gathered(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        part = getattr(importlib.import_module(f"loamgrid.plans.{module}"), name)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"queries registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gathered("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gathered("SQL")
