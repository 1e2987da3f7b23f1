"""Registration of the checked queries.

Each registered query reads the driver tables from ``sf_dir`` (whole
tables, lazily) and runs the library's operators; ``sql`` is an independent
DuckDB statement over the same tables that must give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key``."""

    def wrap(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key!r}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a lazy DataFrame (column pruning and filter
    pushdown reach the Parquet scan)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
