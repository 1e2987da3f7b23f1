"""Sorts, limits and set operations.

Nulls sort last in both directions. ``sort(...).limit(n)`` plans as
``TakeOrderedAndProject`` (a per-partition top-k), never a global sort.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.columns import resolve_column
from gridspark.operators.aggregate import distinct_rows
from gridspark.operators.join import stack


def sort_columns(df: DataFrame, by, ascending=True, reverse: bool = False) -> list[Column]:
    """Sort expressions, nulls last. ``by`` holds names or ``(name, asc)``
    pairs; ``ascending`` is one shared direction or one per column."""
    if isinstance(by, str):
        by = [by]
    items = []
    for i, b in enumerate(by):
        if isinstance(b, (tuple, list)):
            name, asc = b[0], bool(b[1])
        else:
            name = b
            asc = ascending[i] if isinstance(ascending, (list, tuple)) else bool(ascending)
        items.append((resolve_column(name, df.columns), asc))
    out = []
    for name, asc in items:
        if reverse:
            asc = not asc
        c = F.col(f"`{name}`")
        out.append(c.asc_nulls_last() if asc else c.desc_nulls_last())
    return out


def sort(df: DataFrame, by, ascending=True) -> DataFrame:
    """O1: sort by one or many columns, nulls last."""
    return df.orderBy(*sort_columns(df, by, ascending))


def limit(df: DataFrame, n: int) -> DataFrame:
    """O2."""
    return df.limit(n)


def top_n(df: DataFrame, column, n: int, ascending: bool = False,
          tiebreak: Sequence[str] = ()) -> DataFrame:
    """O3: the ``n`` rows with the largest (or smallest) ``column``; the
    ``tiebreak`` columns make the cut deterministic."""
    order = sort_columns(df, [(column, ascending)] + [(t, True) for t in tiebreak])
    return df.orderBy(*order).limit(n)


#: O4 and O5 are J12 and A11 under the names of set operations.
union_all = stack
distinct = distinct_rows
