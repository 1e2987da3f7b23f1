"""Outlier flags (U1-U4). Nulls are never outliers. Thresholds computed
from the whole column enter the plan as scalar subqueries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.columns import resolve_column
from gridspark.plans.ordered import quantile_array


def _c(n: str) -> Column:
    return F.col(f"`{n}`")


def iqr_bounds(df: DataFrame, column: str, k: float = 1.5, exact: bool = True) -> tuple[Column, Column]:
    qv = quantile_array(df, column, [0.25, 0.75], exact=exact).select("values").scalar()
    q1, q3 = qv[0], qv[1]
    iqr = q3 - q1
    return q1 - F.lit(k) * iqr, q3 + F.lit(k) * iqr


def outlier_flag(df: DataFrame, column, method: str = "iqr", k: float = 1.5, threshold: float = 3.0,
                 lower=None, upper=None, exact: bool = True) -> Column:
    """Boolean (never null) outlier test by ``iqr`` (U1), ``zscore`` (U2,
    sample std; a constant column has none) or ``bounds`` (U3)."""
    col = resolve_column(column, df.columns)
    v = _c(col).cast("double")
    if method == "iqr":
        lo, hi = iqr_bounds(df, col, k, exact)
        flag = (v < lo) | (v > hi)
    elif method == "zscore":
        st = df.select(F.struct(F.avg(v).alias("m"), F.stddev_samp(v).alias("s")).alias("x")).scalar()
        flag = (st["s"] > 0) & (F.abs(v - st["m"]) > F.lit(threshold) * st["s"])
    elif method == "bounds":
        if lower is None and upper is None:
            raise ValueError("bounds needs lower and/or upper")
        flag = F.lit(False)
        if lower is not None:
            flag = flag | (v < F.lit(float(lower)))
        if upper is not None:
            flag = flag | (v > F.lit(float(upper)))
    else:
        raise ValueError(f"unknown method {method!r}; choose iqr, zscore or bounds")
    return F.coalesce(flag, F.lit(False))


def flag_outliers(df: DataFrame, column, method: str = "iqr", name: str | None = None, **kw) -> DataFrame:
    """Add ``<col>_outlier``."""
    col = resolve_column(column, df.columns)
    return df.withColumn(name or f"{col}_outlier", outlier_flag(df, col, method, **kw))


def outliers(df: DataFrame, column, method: str = "iqr", keep: str = "only", **kw) -> DataFrame:
    """U4: keep only the outliers (``only``) or remove them (``remove``)."""
    f = outlier_flag(df, column, method, **kw)
    if keep == "only":
        return df.where(f)
    if keep == "remove":
        return df.where(~f)
    raise ValueError("keep must be 'only' or 'remove'")


def outlier_summary(df: DataFrame, column, method: str = "iqr", **kw) -> DataFrame:
    """U4: count and percentage of outliers."""
    f = outlier_flag(df, column, method, **kw)
    flagged = df.select(f.alias("_f"))
    return flagged.agg(F.count_if("_f").alias("outliers"), F.count(F.lit(1)).alias("rows")).select(
        "outliers", "rows",
        F.round(F.try_divide(F.col("outliers") * F.lit(100.0), F.col("rows")), 2).alias("pct"))
