from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, root)`` under ``name`` with its comparison SQL."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, root: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, root)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def avg6(expr: str) -> str:
    """SQL for a decimal(24,6) mean of a two-decimal column, rounded half up."""
    cents = f"CAST(SUM({expr}) * 100 AS HUGEINT)"
    return (
        f"CAST(CAST((2 * {cents} * 10000 + COUNT({expr})) // (2 * COUNT({expr})) AS DECIMAL(30,0))"
        " * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(24,6))"
    )
