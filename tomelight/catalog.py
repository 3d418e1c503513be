"""Every registered query of the library proper, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "relevant_pages_rerank"
MODULES = ("search_queries", "core_queries", "text_queries", "audit_queries", "record_queries")


def _load() -> None:
    for name in MODULES:
        import_module(f"tomelight.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tomelight.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from tomelight.plans.registry import SQL

    _load()
    return dict(SQL)
