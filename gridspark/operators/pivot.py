"""Pivot tables and cross tabulations (V-P1 to V-P5).

The pivot values decide the output *schema*, so they are either passed in or
read with one distinct query; ``max_values`` may bound that (more raise instead
of being cut off), which is left to the caller. With the values known, Spark
plans the pivot as a single aggregation with one conditional aggregate per value.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.columns import resolve_column, resolve_columns
from gridspark.operators.aggregate import NUMERIC, agg_expr, canonical_agg
from gridspark.operators.clean import _can_hold


def _c(n: str) -> Column:
    return F.col(f"`{n}`")


def pivot_values(df: DataFrame, columns: Sequence[str], max_values: int | None = None) -> list[tuple]:
    """Sorted distinct values of the pivot columns, as tuples (none of them null)."""
    rows = df.select(*[_c(c) for c in columns]).distinct().orderBy(*[_c(c) for c in columns])
    if max_values is not None:
        rows = rows.limit(max_values + 1)
    found = [tuple(r) for r in rows.collect()]
    if max_values is not None and len(found) > max_values:
        raise ValueError(f"more than {max_values} pivot values; pass values= explicitly")
    return found


def _pivoted(df: DataFrame, rows: list[str], columns: list[str], values: list[tuple], names: list[str],
             cell: Column) -> DataFrame:
    """``rows`` x ``values`` of ``cell``; pivot columns are told apart by the
    values themselves and named by position."""
    if len(set(names)) < len(names) or set(names) & set(rows):
        raise ValueError(f"pivot column names are not unique: {sorted(n for n in names if names.count(n) > 1 or n in rows)}")
    if len(columns) == 1:
        key, keys = _c(columns[0]), [v[0] for v in values]
    else:
        # quoted text of the struct: distinct values never share it
        key = F.to_json(F.struct(*[_c(c) for c in columns]))
        given = df.sparkSession.createDataFrame(values, df.select(*[_c(c) for c in columns]).schema)
        keys = [r[0] for r in given.select(F.to_json(F.struct(*[_c(c) for c in columns]))).collect()]
    out = df.withColumn("_pk", key).groupBy(*[_c(r) for r in rows]).pivot("_pk", keys).agg(cell)
    return out.toDF(*rows, *names)


def pivot_table(df: DataFrame, rows: Sequence, columns: Sequence | None, value, agg: str = "sum",
                values: Sequence | None = None, fill=0, max_values: int | None = None, sep: str = "_") -> DataFrame:
    """V-P1..V-P3: ``rows`` x ``columns`` of ``agg(value)``.

    Rows with a null row or column key are dropped; empty cells are filled
    with ``fill`` (None keeps them null, as does a fill that the aggregate's type cannot
    hold, such as 0 for text). Output columns are named by their
    value; several pivot columns by their values joined with ``sep`` (names that
    come out equal raise: choose another ``sep``). ``values`` gives the pivot
    values, as tuples for several columns. No pivot column gives a plain group
    summary.
    """
    rcols = resolve_columns([rows] if isinstance(rows, (str, int)) else rows, df.columns)
    v = resolve_column(value, df.columns)
    f = canonical_agg(agg)
    if f == "median":
        raise ValueError("median is not a pivot aggregate; use sum, mean, count, min, max, nunique")
    base = df
    for r in rcols:
        base = base.where(_c(r).isNotNull())
    if not columns:
        return base.groupBy(*[_c(r) for r in rcols]).agg(agg_expr(f, v).alias(f"{f}_{v}")).orderBy(
            *[_c(r) for r in rcols])
    ccols = resolve_columns([columns] if isinstance(columns, (str, int)) else columns, df.columns)
    for c in ccols:
        base = base.where(_c(c).isNotNull())
    vals = pivot_values(base, ccols, max_values) if values is None else [
        tuple(x) if isinstance(x, (tuple, list)) else (x,) for x in values]
    names = [sep.join(str(x) for x in t) for t in vals]
    out = _pivoted(base, rcols, ccols, vals, names, agg_expr(f, v))
    if fill is not None:
        number = isinstance(fill, (int, float)) and not isinstance(fill, bool)
        fits = {x.name: (number and isinstance(x.dataType, NUMERIC)) or _can_hold(x.dataType, fill) for x in out.schema}
        out = out.select(*[_c(r) for r in rcols],
                         *[F.coalesce(_quoted(n), F.lit(fill)).alias(n) if fits[n] else _quoted(n) for n in names])
    return out.orderBy(*[_c(r) for r in rcols])


def _quoted(name: str) -> Column:
    """A column of any name, backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def crosstab(df: DataFrame, row, column, totals: bool = False, values: Sequence | None = None,
             total_label: str = "Total", max_values: int | None = None) -> DataFrame:
    """V-P4/V-P5: counts of ``row`` x ``column`` values, nulls dropped, zero
    filled; ``totals`` adds a Total column and a Total row (grand total in
    the corner). With totals the row key is text, so the label fits."""
    r, c = resolve_column(row, df.columns), resolve_column(column, df.columns)
    base = df.where(_c(r).isNotNull() & _c(c).isNotNull())
    vals = pivot_values(base, [c], max_values) if values is None else [(x,) for x in values]
    names = [str(t[0]) for t in vals]
    body = _pivoted(base, [r], [c], vals, names, F.count(F.lit(1)))
    body = body.select(_c(r), *[F.coalesce(_quoted(n), F.lit(0)).cast("long").alias(n) for n in names])
    if not totals:
        return body.orderBy(_c(r))
    total_col = sum((_quoted(n) for n in names), F.lit(0)).cast("long").alias(total_label)
    body = body.select(_c(r).cast("string").alias(r), *[_quoted(n) for n in names], total_col)
    # the total row sums the (small) body: no second pass over the table
    foot = body.agg(*[F.coalesce(F.sum(_quoted(n)), F.lit(0)).cast("long").alias(n) for n in names],
                    F.coalesce(F.sum(_c(total_label)), F.lit(0)).cast("long").alias(total_label))
    foot = foot.select(F.lit(total_label).alias(r), *[_quoted(n) for n in names], _c(total_label))
    return body.unionByName(foot)


def pivot_long(df: DataFrame, rows: Sequence, columns: Sequence, value, agg: str = "sum") -> DataFrame:
    """V-P1/V-P2 without a schema that depends on the data: one row for each non-empty
    cell, (row keys, column keys, ``<agg>_<value>``). A plain grouped aggregation: nothing
    is read first, and neither many column keys nor many cells of one row matter."""
    rcols = resolve_columns([rows] if isinstance(rows, (str, int)) else rows, df.columns)
    ccols = resolve_columns([columns] if isinstance(columns, (str, int)) else columns, df.columns)
    v, f = resolve_column(value, df.columns), canonical_agg(agg)
    if f == "median":
        raise ValueError("median is not a pivot aggregate; use sum, mean, count, min, max, nunique")
    base = df
    for c in [*rcols, *ccols]:
        base = base.where(_c(c).isNotNull())
    return base.groupBy(*[_c(c) for c in [*rcols, *ccols]]).agg(agg_expr(f, v).alias(f"{f}_{v}"))


def pivot_map(df: DataFrame, rows: Sequence, columns: Sequence, value, agg: str = "sum", name: str = "cells",
              sep: str = "_") -> DataFrame:
    """V-P1/V-P2 with unknown column keys: one row for each row key, its cells as a map
    from column key (several joined with ``sep``) to aggregate, keys in order. Rows
    whose cells do not fit a value of their own belong into ``pivot_long``; column keys of
    one row that come out equal as text raise."""
    rcols = resolve_columns([rows] if isinstance(rows, (str, int)) else rows, df.columns)
    ccols = resolve_columns([columns] if isinstance(columns, (str, int)) else columns, df.columns)
    if name in rcols:
        raise ValueError(f"the map needs a name of its own, not {name!r}")
    long = pivot_long(df, rcols, ccols, value, agg)
    cell = long.columns[-1]
    entry = F.struct(F.concat_ws(sep, *[_c(c).cast("string") for c in ccols]).alias("key"),
                     F.col(f"`{cell}`").alias("value"))
    frame = long.select(*[_c(r).alias(f"r{i}") for i, r in enumerate(rcols)], entry.alias("_cell"))
    out = frame.groupBy(*[f"r{i}" for i in range(len(rcols))]).agg(
        F.map_from_entries(F.array_sort(F.collect_list("_cell"))).alias("_cells"))
    return out.select(*[F.col(f"r{i}").alias(r) for i, r in enumerate(rcols)], F.col("_cells").alias(name))
