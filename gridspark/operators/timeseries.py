"""Calendar grouping and date-column discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions.columns import resolve_column
from gridspark.functions.core import period_start, to_date
from gridspark.operators.aggregate import agg_expr, canonical_agg


def _c(n: str) -> Column:
    return F.col(f"`{n}`")


def period_aggregate(df: DataFrame, date_column, period: str = "month", value=None,
                     agg: str = "sum") -> DataFrame:
    """Group by day/week/month/quarter/year of ``date_column``.

    Weeks start on Monday. The key column ``period`` is the period's first
    instant (``timestamp_ntz``), or the year number for ``year``. Rows
    with a null date are dropped. ``agg`` is sum, mean or count (count with
    no value counts rows).
    """
    d = resolve_column(date_column, df.columns)
    base = df.where(_c(d).isNotNull())
    key = F.year(_c(d)) if period == "year" else period_start(_c(d), period)
    if value is None:
        e = F.count(F.lit(1)).alias("count")
    else:
        v = resolve_column(value, df.columns)
        f = canonical_agg(agg)
        e = agg_expr(f, v).alias(f"{f}_{v}")
    return base.groupBy(key.alias("period")).agg(e).orderBy("period")


def date_columns(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``(column, kind, parse_rate)`` for typed date columns and text
    columns whose non-null values parse as dates at more than ``threshold``
    (measured over the whole column in one pass)."""
    exprs = []
    for f in df.schema.fields:
        c = _c(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            exprs.append(F.struct(F.lit(f.name).alias("column"), F.lit("date").alias("kind"),
                                  F.lit(1.0).alias("parse_rate")))
        elif isinstance(f.dataType, T.StringType):
            rate = F.try_divide(F.count_if(c.isNotNull() & to_date(c).isNotNull()).cast("double"),
                                F.count(c).cast("double"))
            exprs.append(F.struct(F.lit(f.name).alias("column"), F.lit("text").alias("kind"),
                                  rate.alias("parse_rate")))
    if not exprs:
        return df.sparkSession.createDataFrame([], "column string, kind string, parse_rate double")
    row = df.agg(F.array(*exprs).alias("s")).select(F.inline("s"))
    return row.where((F.col("kind") == "date") | (F.col("parse_rate") > threshold))
