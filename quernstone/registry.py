"""Every named query with its oracle SQL, gathered from the operator modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.plans.catalog import Catalog

CATALOG = Catalog()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return CATALOG.queries()


def oracle_sql() -> dict[str, str]:
    return CATALOG.oracle_sql()


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CATALOG.flagship(spark, sf_dir)
