"""All queries of the reference's own operators, by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assaylake.plans import books, guidance, monitoring, reading, reviews, site, texts

SMOKE_DIR = "/root/testdata/sf0.001"

_MODULES = (monitoring, texts, reading, books, guidance, site, reviews)


def entry(spark: SparkSession) -> DataFrame:
    """The verdict of every monitoring round under both rules."""
    return monitoring.screen_two_rules(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for module in _MODULES for k, v in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for module in _MODULES for k, v in module.SQL.items()}
