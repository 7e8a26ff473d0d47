"""All registered queries of the core, with their DuckDB statements where SQL can restate them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "token_counts"
#: Modules of this package that hold QUERIES and SQL.
MODULES: list[str] = ["records", "text", "words", "spans", "models", "corpora", "features", "files", "crfs", "structures", "boundaries"]


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        found = getattr(importlib.import_module(f"lexiframe.plans.{m}"), name)
        if twice := out.keys() & found.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= found
    return out


def queries() -> dict[str, Query]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
