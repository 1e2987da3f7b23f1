"""Plain SQL over named tables.

Every named table is registered as a temporary view, so SQL can join them;
the current table is also visible as ``df``. Spark SQL gives window
functions, CTEs, subqueries, set operations, grouping sets and semi/anti
joins; ``QUALIFY`` and ``ASOF JOIN`` are not Spark SQL syntax.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_IDENT = re.compile(r"^[A-Za-z_]\w*$")
_READ_ONLY = re.compile(r"^\s*(\(\s*)*(SELECT|WITH|VALUES|TABLE|FROM)\b", re.IGNORECASE)


def check_identifier(name: str) -> str:
    if not _IDENT.match(name):
        raise ValueError(f"not a valid table name: {name!r}")
    return name


def register_tables(tables: dict[str, DataFrame]) -> None:
    """Expose each DataFrame under its name for SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(check_identifier(name))


def _strip_comments(q: str) -> str:
    q = re.sub(r"/\*.*?\*/", " ", q, flags=re.S)
    return re.sub(r"--[^\n]*", " ", q)


def run_sql(spark: SparkSession, query: str, tables: dict[str, DataFrame] | None = None,
            current: DataFrame | None = None, read_only: bool = True) -> DataFrame:
    """Run a SQL query; ``current`` is visible as ``df``. With
    ``read_only`` only queries (SELECT / WITH / VALUES / TABLE / FROM) are
    accepted, one statement."""
    if tables:
        register_tables(tables)
    if current is not None:
        current.createOrReplaceTempView("df")
    body = _strip_comments(query).strip().rstrip(";")
    if read_only:
        if not _READ_ONLY.match(body) or ";" in body:
            raise ValueError("only a single read-only query is accepted")
    return spark.sql(body)


def keep_result(df: DataFrame, name: str) -> DataFrame:
    """Keep a query result under a name for later SQL (a lazy view)."""
    df.createOrReplaceTempView(check_identifier(name))
    return df
