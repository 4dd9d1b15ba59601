"""Registered queries: name -> (Spark callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    """Register a query; the views assume a UTC session, so the wrapper sets it."""
    def deco(fn):
        @wraps(fn)
        def utc(spark: SparkSession, sf_dir: str) -> DataFrame:
            if spark.conf.get("spark.sql.session.timeZone") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = (utc, sql)
        return utc
    return deco


def load() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from . import catalog_overview, catalog_privacy, catalog_rules, catalog_sources, catalog_tree, catalog_triage  # noqa: F401
    return QUERIES
