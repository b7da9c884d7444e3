"""Query catalog: name -> Spark builder ``(spark, sf_dir) -> DataFrame`` and
name -> DuckDB oracle SQL over the same tables.

Plan modules register with ``@query(name, oracle_body)``; the body is
appended to the shared fixture-view CTE prefix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helpdeck.plans.oracle_views import sql
from helpdeck.sources.fixtures import TicketViews

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, builder=None):
    """Register a Spark builder and (optionally) its oracle body; ``builder``
    turns the body into full SQL (default: fixture-view prefix + body)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = (builder or sql)(oracle)
        return fn
    return deco


def views(spark: SparkSession, sf_dir: str) -> TicketViews:
    return TicketViews(spark, sf_dir)
