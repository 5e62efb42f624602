"""Every query of the library by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _modules() -> list:
    from emberlog.plans import detail_queries, detect_queries, format_queries, rule_queries, search_queries, source_queries, stream_queries

    return [search_queries, detect_queries, rule_queries, source_queries, format_queries, detail_queries, stream_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in _modules() for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source of the events that a search finds."""
    from emberlog.operators import facets, search
    from emberlog.plans.views import log_events

    return facets.aggregate(search.where(log_events(spark, sf_dir), "sev:high AND user:u1*"), "source")
