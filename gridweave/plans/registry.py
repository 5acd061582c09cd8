"""A registry of table queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Registers ``f(t)``, where ``t(name)`` reads a table, under the function's name."""

    def keep(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(lambda t: table(spark, sf_dir, t))
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return keep
