"""The library's queries over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

for _name in ("cycles", "relations", "texts", "store", "streams", "contracts", "artifacts", "decisions", "reconciled", "rebuilt"):
    _module = import_module(f"{__name__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
