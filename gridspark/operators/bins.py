"""Binning (B1-B3). Bin numbers are 1-based; intervals are right-closed
``(lo, hi]`` with the first one closed on the left, like ``pandas.cut``.

Edges computed from the data (min/max, quantiles) enter the plan as one
scalar subquery; the bin of a value is ``1 + count(inner edges < value)``,
a per-row array expression with no join.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.columns import resolve_column
from gridspark.functions.names import plain_names
from gridspark.plans.ordered import quantile_array


def _c(n: str) -> Column:
    return F.col(f"`{n}`")


def _bin_of(v: Column, inner: list[Column]) -> Column:
    """1 + number of inner edges below ``v`` (unrolled: edges may be scalar
    subqueries, which Spark does not allow inside lambda functions)."""
    n = F.lit(1)
    for e in inner:
        n = n + F.coalesce((v > e).cast("int"), F.lit(0))
    return F.when(v.isNotNull(), n)


def equal_width_bins(df: DataFrame, column, n: int, name: str | None = None) -> DataFrame:
    """B1: ``n`` equal-width bins over [min, max]; adds ``<name>`` (bin
    number), ``<name>_lo`` and ``<name>_hi`` (its edges; the lowest edge is
    widened by 0.1 % of the range, and an all-equal column is widened
    around its value, as ``pandas.cut`` does)."""
    if n < 1:
        raise ValueError("n must be >= 1")
    col = resolve_column(column, df.columns)
    out = name or f"{col}_bin"
    v = _c(col).cast("double")
    stats = df.select(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias("s")).scalar()
    lo0, hi0 = stats["lo"], stats["hi"]
    same = lo0 == hi0
    lo = F.when(same & (lo0 == 0), F.lit(-0.001)).when(same, lo0 - F.lit(0.001) * F.abs(lo0)).otherwise(lo0)
    hi = F.when(same & (hi0 == 0), F.lit(0.001)).when(same, hi0 + F.lit(0.001) * F.abs(hi0)).otherwise(hi0)
    step = (hi - lo) / F.lit(n)
    b = _bin_of(v, [lo + step * F.lit(i) for i in range(1, n)])
    first_lo = F.when(same, lo).otherwise(lo - (hi - lo) * F.lit(0.001))
    return df.select("*", b.alias(out),
                     F.when(b == 1, first_lo).otherwise(lo + step * (b - 1)).alias(f"{out}_lo"),
                     F.when(b == n, hi).otherwise(lo + step * b).alias(f"{out}_hi"))


def quantile_bins(df: DataFrame, column, q: int, name: str | None = None, exact: bool = True) -> DataFrame:
    """B2: ``q`` quantile bins; duplicate edges are dropped (fewer bins; none,
    so null bins, for a column of one value or of nulls only).
    Edges are the exact quantiles 0, 1/q, ..., 1 (``exact=False``: approximate
    one-pass quantiles)."""
    if q < 1:
        raise ValueError("q must be >= 1")
    col = resolve_column(column, df.columns)
    out = name or f"{col}_qbin"
    qs = [i / q for i in range(q + 1)]
    found = quantile_array(df, col, qs, exact=exact).select(F.array_distinct("values").alias("e")).scalar()
    frame, to = plain_names(df)
    frame = frame.withColumn("_e", found)     # one subquery; everything after reads the column
    k, v = F.size("_e"), F.col(to[col]).cast("double")
    # 1 + number of inner edges (2 .. k-1 of the distinct edge list) below the value
    inner = F.slice("_e", F.lit(2), F.greatest(k - 2, F.lit(0)))
    b = F.when((k >= 2) & v.isNotNull(), F.size(F.filter(inner, lambda e: e < v)) + 1)
    frame = frame.withColumn("_bin", b)
    return frame.select(*[F.col(to[c]).alias(c) for c in df.columns], F.col("_bin").alias(out),
                        F.try_element_at("_e", F.col("_bin")).alias(f"{out}_lo"),
                        F.try_element_at("_e", F.col("_bin") + 1).alias(f"{out}_hi"))


def custom_bins(df: DataFrame, column, edges: Sequence[float], labels: Sequence[str] | None = None,
                name: str | None = None) -> DataFrame:
    """Bins on given edges; values outside [first, last] get null.
    Adds the bin number, or the label when ``labels`` are given."""
    e = [float(x) for x in edges]
    if len(e) < 2 or any(b <= a for a, b in zip(e, e[1:])):
        raise ValueError("edges must be increasing, at least two")
    if labels is not None and len(labels) != len(e) - 1:
        raise ValueError("need one label per bin")
    col = resolve_column(column, df.columns)
    out = name or f"{col}_bin"
    v = _c(col).cast("double")
    inside = (v >= e[0]) & (v <= e[-1])
    b = F.when(inside, _bin_of(v, [F.lit(x) for x in e[1:-1]]))
    if labels is not None:
        b = F.element_at(F.array(*[F.lit(x) for x in labels]), b)
    return df.withColumn(out, b)
