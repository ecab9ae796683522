"""Query registry: name -> (spark, data folder) -> DataFrame, and its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load_tables
from .oracle import ORACLE_SQL
from .queries import PLANS
from .stored import ORACLE_SQL as STORED_SQL
from .stored import QUERIES as STORED


def _bind(plan) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(load_tables(spark, sf_dir))

    run.__name__ = plan.__name__
    run.__doc__ = plan.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(plan) for name, plan in PLANS.items()} | STORED


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL | STORED_SQL
