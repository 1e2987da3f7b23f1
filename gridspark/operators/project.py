"""Projections, slices and samples."""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.columns import parse_column_list, resolve_column, resolve_columns
from gridspark.operators.order import sort_columns
from gridspark.plans.order_index import OrderIndex, first_page


def _c(name: str):
    return F.col(f"`{name}`")


def select_columns(df: DataFrame, refs, fuzzy: float | None = None) -> DataFrame:
    """Keep columns given by names, numbers, letters, unique name
    parts, or a list spec such as ``"1,3,5-7"`` / ``"all"``. With ``fuzzy``, a
    list may also hold misspelt names (see ``resolve_column``)."""
    if isinstance(refs, str):
        cols = parse_column_list(refs, df.columns)
    else:
        cols = resolve_columns(refs, df.columns, fuzzy)
    return df.select(*[_c(c) for c in cols])


def column_window(df: DataFrame, start: int, width: int) -> DataFrame:
    """``width`` columns starting at 0-based position ``start``."""
    if start < 0 or width < 0:
        raise ValueError("start and width must be >= 0")
    return df.select(*[_c(c) for c in df.columns[start:start + width]])


def rename_column(df: DataFrame, old, new: str) -> DataFrame:
    """Rename one column; the new name must not exist already."""
    src = resolve_column(old, df.columns)
    if new in df.columns and new != src:
        raise ValueError(f"column {new!r} already exists")
    return df.withColumnRenamed(src, new)


def drop_columns(df: DataFrame, refs) -> DataFrame:
    """Drop the given columns (unknown references raise)."""
    cols = resolve_columns(refs if not isinstance(refs, str) else [refs], df.columns)
    return df.drop(*cols)


def clean_names(df: DataFrame) -> DataFrame:
    """Strip, lower-case and turn whitespace runs into ``_``; a clash
    between two cleaned names raises instead of silently duplicating."""
    names = [re.sub(r"\s+", "_", c.strip().lower()) for c in df.columns]
    dup = {n for n in names if names.count(n) > 1}
    if dup:
        raise ValueError(f"cleaned column names collide: {sorted(dup)}")
    return df.toDF(*names)


def add_constant(df: DataFrame, name: str, value, dtype: str | None = None) -> DataFrame:
    """Add a constant column; error if the name exists."""
    if name in df.columns:
        raise ValueError(f"column {name!r} already exists")
    lit = F.lit(value)
    return df.withColumn(name, lit.cast(dtype) if dtype else lit)


def head(df: DataFrame, n: int = 10, order_by: Sequence | None = None,
         columns: Sequence | None = None) -> DataFrame:
    """P10: first ``n`` rows; pass ``order_by`` for a defined order (plans as
    a bounded top-k, never a full sort)."""
    out = select_columns(df, columns) if columns else df
    if order_by:
        out = out.orderBy(*sort_columns(out, order_by))
    return out.limit(n)


def tail(df: DataFrame, n: int, order_by: Sequence) -> DataFrame:
    """Last ``n`` rows in ``order_by`` order (top-k of the reversed
    order, returned in the forward order)."""
    if not order_by:
        raise ValueError("tail needs order_by: Spark rows have no inherent order")
    back = sort_columns(df, order_by, reverse=True)
    return df.orderBy(*back).limit(n).orderBy(*sort_columns(df, order_by))


def page(df: DataFrame, number: int, size: int, order_by: Sequence,
         reset_past_end: bool = True) -> DataFrame:
    """Rows of page ``number`` (1-based) of ``size`` rows.

    Page 1 is a bounded top-k. A later page goes through an ``OrderIndex``: bounds
    and counts of the order keys, then one read of the slices that hold the page;
    nothing is written. Keep an index to read several pages of one table. Rows equal
    in every order key come in the order of a row hash. A page past the end gives
    page 1 when ``reset_past_end``, else no rows.
    """
    if number < 1 or size < 1:
        raise ValueError("page number and size must be >= 1")
    if number == 1:
        return first_page(df, order_by, size)
    return OrderIndex(df, order_by).page(number, size, reset_past_end)


def sample_rows(df: DataFrame, n: int, key: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Deterministic sample of ``n`` rows: the ``n`` smallest MD5 digests of
    the seed and the key columns as text, joined with ``|`` (a bounded top-k, the
    same rows on any partitioning). ``key`` defaults to all columns."""
    cols = list(key) if key else df.columns
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols]))
    return df.withColumn("_h", h).orderBy("_h", *[_c(c) for c in cols]).limit(n).drop("_h")


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Bernoulli sample of about ``fraction`` of the rows."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)
