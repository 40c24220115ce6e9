"""One query per operator over the test tables, with its DuckDB twin where SQL can say it.

Keys are the operator id of the survey in lower case plus a short name. Doubles are rounded on both
sides, counts are BIGINT, every top-1 has a tie-break."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query builder under ``name``, with its oracle text."""
    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def load_all() -> None:
    from . import q_alignment, q_geometry, q_relational, q_sources, q_streaming, q_workflow  # noqa: F401
