"""Names of the registered queries, each with the SQL that gives the same rows (None where SQL can't express it)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ["interval_queries", "graph_queries", "alignment_queries", "sequence_queries", "variant_queries", "pileup_queries", "calling_queries", "record_queries", "ordering_queries", "layout_queries", "misc_queries"]


def _all() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for name in MODULES:
        found |= importlib.import_module(f"{__package__}.{name}").QUERIES
    return found


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
