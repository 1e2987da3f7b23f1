"""Cleaning: nulls, duplicates, type conversion, find & replace, edits
(C1-C18).

Table-wide statistics used for filling (mean, median, mode) enter the plan as
scalar subqueries: computed once, distributed as constants, never joined.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions.columns import resolve_column, resolve_columns
from gridspark.functions.core import (clean_number, literal_regex, literal_replacement, to_bool,
                                      to_date, to_float, to_int)
from gridspark.operators.aggregate import NUMERIC
from gridspark.functions.names import plain_names
from gridspark.plans.ordered import exact_quantiles, order_key, segmented_last


def _c(n: str) -> Column:
    return F.col(f"`{n}`")


def _cols(df: DataFrame, columns) -> list[str]:
    if columns is None:
        return list(df.columns)
    return resolve_columns([columns] if isinstance(columns, (str, int)) else columns, df.columns)


def drop_nulls(df: DataFrame, subset=None, how: str = "any") -> DataFrame:
    """Drop rows with a null in ``subset`` (``how='all'``: all null)."""
    return df.na.drop(how=how, subset=_cols(df, subset))


def _can_hold(dtype: T.DataType, value) -> bool:
    if isinstance(value, bool):
        return isinstance(dtype, T.BooleanType)
    if isinstance(value, (int, float, Decimal)):
        if isinstance(dtype, T.IntegralType):
            bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31}.get(type(dtype), 63)
            return value == value and abs(value) < float("inf") and int(value) == value and -(1 << bits) <= value < 1 << bits
        return isinstance(dtype, NUMERIC)
    if isinstance(value, dt.datetime):
        return isinstance(dtype, (T.TimestampType, T.TimestampNTZType))
    if isinstance(value, dt.date):
        return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return isinstance(value, str) and isinstance(dtype, T.StringType)


def fill_value(df: DataFrame, value, columns=None) -> DataFrame:
    """Replace nulls with ``value`` cast to each column's type. Without
    ``columns`` every column whose type can hold the value is filled; named
    columns are filled as told (a value that does not fit raises at run time
    under ANSI casts)."""
    cols = set(_cols(df, columns))
    if columns is None:
        cols = {f.name for f in df.schema.fields if _can_hold(f.dataType, value)}
    out = []
    for f in df.schema.fields:
        if f.name in cols:
            out.append(F.coalesce(_c(f.name), F.lit(value).cast(f.dataType)).alias(f.name))
        else:
            out.append(_c(f.name))
    return df.select(*out)


def column_stat(df: DataFrame, column: str, stat: str) -> Column:
    """Scalar subquery of a whole-column statistic: mean, median (exact) or
    mode (most frequent non-null value; ties to the smallest value)."""
    c = _c(column)
    if stat == "mean":
        return df.select(F.avg(c)).scalar()
    if stat == "median":
        return exact_quantiles(df, column, [0.5]).select("value").scalar()
    if stat == "mode":
        counts = df.where(c.isNotNull()).groupBy(c.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        return counts.select(F.min_by("_v", F.struct(-F.col("_n"), F.col("_v")))).scalar()
    raise ValueError(f"unknown statistic {stat!r}; choose mean, median or mode")


def fill_stat(df: DataFrame, columns, stat: str = "mean") -> DataFrame:
    """Fill nulls with the column's mean, median or mode. Mean and median
    apply to numeric columns only; mode to any column."""
    cols = _cols(df, columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    if stat in ("mean", "median"):
        bad = [c for c in cols if not isinstance(types[c], NUMERIC)]
        if bad:
            raise ValueError(f"{stat} fill needs numeric columns, got {bad}")
    repl = {c: column_stat(df, c, stat) for c in cols}
    return df.select(*[
        F.coalesce(_c(f.name), repl[f.name].cast(f.dataType)).alias(f.name) if f.name in repl
        else _c(f.name) for f in df.schema.fields])


def blank_to_null(df: DataFrame, columns=None) -> DataFrame:
    """C4: exactly-empty text becomes null (whitespace is kept)."""
    cols = set(_cols(df, columns))
    return df.select(*[
        F.nullif(_c(f.name), F.lit("")).alias(f.name)
        if f.name in cols and isinstance(f.dataType, T.StringType) else _c(f.name)
        for f in df.schema.fields])


def forward_fill(df: DataFrame, columns, order_by: Sequence[str], partition_by: Sequence[str] = (),
                 strategy: str = "auto") -> DataFrame:
    """Carry the last non-null value forward in ``order_by`` order
    (mandatory), optionally within ``partition_by`` groups. Groups proven
    to fit one task use a plain window; larger ones are filled in blocks so
    that no group is filled inside a single task."""
    if not order_by:
        raise ValueError("forward fill needs order_by")
    cols = _cols(df, columns)
    ob = resolve_columns(order_by, df.columns)
    pb = resolve_columns(partition_by, df.columns) if partition_by else []
    frame, to = plain_names(df)
    return segmented_last(frame, [to[c] for c in cols], [to[c] for c in ob], [to[c] for c in pb],
                          strategy=strategy).toDF(*df.columns)


def all_null_columns(df: DataFrame) -> list[str]:
    """Names of columns holding no value at all (one aggregation; the
    answer decides the output schema, so its one row is read)."""
    if not df.columns:
        return []
    row = df.agg(*[F.max(_c(c).isNotNull().cast("int")).alias(f"_{i}")
                   for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if not row[f"_{i}"]]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop the columns that are entirely null."""
    return df.drop(*all_null_columns(df))


def blank_flags(df: DataFrame, columns=None) -> DataFrame:
    """Add ``<col>_is_blank`` (true where null)."""
    cols = _cols(df, columns)
    return df.select("*", *[_c(c).isNull().alias(f"{c}_is_blank") for c in cols])


def dedupe(df: DataFrame, subset=None, order_by: Sequence[str] | None = None,
           keep: str = "first") -> DataFrame:
    """Remove duplicate rows.

    Without ``subset`` whole rows are compared (nulls equal). With a subset,
    the first (or last) row per key in ``order_by`` order is kept: a
    ``min_by`` aggregate, so a hot key is reduced map-side instead of being
    sorted in one task. Null order keys sort last. Without ``order_by``, or
    among rows equal in every order key, an arbitrary row is kept.
    """
    if subset is None:
        return df.dropDuplicates()
    keys = _cols(df, subset)
    if not order_by:
        return df.dropDuplicates(keys)
    ob = resolve_columns(order_by, df.columns)
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    row = F.struct(*[_c(c) for c in rest]) if rest else F.lit(None)
    red = df.groupBy(*[_c(k) for k in keys]).agg(
        pick(row, order_key(ob)).alias("_row"))
    return red.select(*[_c(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


CAST_TARGETS = ("text", "int", "float", "bool", "date", "category")


def cast_expr(c: Column, to: str, fmt: str | None = None, on_fraction: str = "null") -> Column:
    if to in ("text", "str", "string"):
        return c.cast("string")
    if to in ("int", "integer"):
        return to_int(c, on_fraction)
    if to in ("float", "double"):
        return to_float(c)
    if to in ("bool", "boolean"):
        return to_bool(c)
    if to == "date":
        return to_date(c, fmt)
    if to == "category":
        return c.cast("string")
    raise ValueError(f"unknown target type {to!r}; choose from {CAST_TARGETS}")


def cast_column(df: DataFrame, column, to: str, fmt: str | None = None,
                on_fraction: str = "null") -> DataFrame:
    """Convert a column; unconvertible values become null.

    ``int`` strips ``$ , %`` and whitespace first; ``bool`` reads the fixed
    true/false words; ``date`` tries ``fmt`` or the fixed format list;
    ``category`` keeps the values as text (see ``rank.category_codes``).
    """
    name = resolve_column(column, df.columns)
    return df.withColumn(name, cast_expr(_c(name), to, fmt, on_fraction))


def cast_report(df: DataFrame, column, to: str, fmt: str | None = None,
                on_fraction: str = "null") -> DataFrame:
    """Failures of a conversion: values that were not null and become null."""
    name = resolve_column(column, df.columns)
    new = cast_expr(_c(name), to, fmt, on_fraction)
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_if(_c(name).isNotNull() & new.isNull()).alias("failed"))


FIND_MODES = ("exact", "contains", "regex")


def match_expr(c: Column, find: str, mode: str = "contains", case: bool = False) -> Column:
    """Boolean: does the text of ``c`` match ``find``."""
    s = c.cast("string")
    if mode == "exact":
        return (s == F.lit(find)) if case else (F.lower(s) == F.lit(find.lower()))
    if mode == "contains":
        return s.contains(find) if case else F.lower(s).contains(find.lower())
    if mode == "regex":
        return s.rlike(("" if case else "(?i)") + find)
    raise ValueError(f"unknown mode {mode!r}; choose from {FIND_MODES}")


def replace_expr(c: Column, find: str, replace: str, mode: str = "contains", case: bool = False) -> Column:
    """Replacement of ``find`` in ``c``: whole value (exact), every literal
    occurrence (contains; ``$`` and ``\\`` in ``replace`` are literal) or
    regex with ``$1`` group references."""
    s = c.cast("string")
    if mode == "exact":
        return F.when(match_expr(c, find, "exact", case), F.lit(replace)).otherwise(s)
    flags = "" if case else "(?i)"
    if mode == "contains":
        return F.regexp_replace(s, flags + literal_regex(find), literal_replacement(replace))
    if mode == "regex":
        return F.regexp_replace(s, flags + find, replace)
    raise ValueError(f"unknown mode {mode!r}; choose from {FIND_MODES}")


def _text_targets(df: DataFrame, columns, cast_all: bool) -> list[str]:
    cols = _cols(df, columns)
    if cast_all:
        return cols
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in cols if isinstance(types[c], T.StringType)]


def find_replace(df: DataFrame, find: str, replace: str, columns=None, mode: str = "contains",
                 case: bool = False, cast_all: bool = False) -> DataFrame:
    """Replace in one or all columns. Only text columns are touched
    unless ``cast_all`` (then the result of those columns is text)."""
    targets = set(_text_targets(df, columns, cast_all))
    return df.select(*[replace_expr(_c(c), find, replace, mode, case).alias(c) if c in targets
                       else _c(c) for c in df.columns])


def replace_first(df: DataFrame, find: str, replace: str, column, order_by: Sequence[str],
                  mode: str = "contains", case: bool = False) -> DataFrame:
    """Replace only in the first matching row of ``column`` in
    ``order_by`` order (nulls last; it should be unique, as all rows equal in
    it to the first match are replaced). The first row's order key is a scalar
    subquery (one ``min`` over the matches)."""
    name = resolve_column(column, df.columns)
    if not order_by:
        raise ValueError("replace_first needs order_by")
    ob = resolve_columns(order_by, df.columns)
    okey = order_key(ob)
    hit = match_expr(_c(name), find, mode, case)
    first = df.where(hit).select(F.min(okey)).scalar()
    new = F.when(hit & okey.eqNullSafe(first), replace_expr(_c(name), find, replace, mode, case)).otherwise(
        _c(name))
    return df.withColumn(name, new)


def match_counts(df: DataFrame, find: str, columns=None, mode: str = "contains",
                 case: bool = False, cast_all: bool = True) -> DataFrame:
    """C17: ``(column, matches)`` for every searched column, one pass."""
    targets = _text_targets(df, columns, cast_all)
    row = df.agg(F.array(*[F.struct(F.lit(c).alias("column"),
                                    F.count_if(F.coalesce(match_expr(_c(c), find, mode, case),
                                                          F.lit(False))).alias("matches"))
                           for c in targets]).alias("s"))
    return row.select(F.inline("s"))


def match_preview(df: DataFrame, find: str, replace: str, column, mode: str = "contains",
                  case: bool = False, n: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    """C17: up to ``n`` matching values with their replacement (before /
    after); ``order_by`` picks which ones."""
    name = resolve_column(column, df.columns)
    rows = df.where(match_expr(_c(name), find, mode, case))
    if order_by:
        rows = rows.orderBy(*[_c(o) for o in resolve_columns(order_by, df.columns)])
    return rows.select(_c(name).cast("string").alias("before"),
                       replace_expr(_c(name), find, replace, mode, case).alias("after")).limit(n)


def update_cells(df: DataFrame, key, key_value, column, value) -> DataFrame:
    """Set ``column = value`` on rows where ``key == key_value``."""
    k, c = resolve_column(key, df.columns), resolve_column(column, df.columns)
    dtype = df.schema[c].dataType
    return df.withColumn(c, F.when(_c(k) == F.lit(key_value), F.lit(value).cast(dtype)).otherwise(_c(c)))


def apply_edits(df: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """C18 batch: ``edits`` holds ``key`` plus the columns to overwrite; a
    non-null edit value replaces the cell. A key with several edits raises, so no
    row is ever multiplied; edits of a null key or of an unknown one change nothing."""
    k = resolve_column(key, df.columns)
    cols = [c for c in edits.columns if c != k]
    unknown = [c for c in cols if c not in df.columns]
    if unknown:
        raise ValueError(f"edited columns {unknown} are not in the table")
    types = {f.name: f.dataType for f in df.schema.fields}
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"several edits of one {k}")).cast("boolean")).otherwise(True)
    e = edits.where(_c(k).isNotNull()).groupBy(_c(k).alias("_key")).agg(
        once.alias("_once"), *[F.first(_c(c)).cast(types[c]).alias(f"_e{i}") for i, c in enumerate(cols)])
    frame, to = plain_names(df)
    j = frame.join(e, frame[to[k]] == e["_key"], "left")
    return j.select(*[F.coalesce(F.when(F.col("_once"), F.col(f"_e{cols.index(c)}")), F.col(to[c])).alias(c)
                      if c in cols else F.col(to[c]).alias(c) for c in df.columns])


def clean_number_column(df: DataFrame, column) -> DataFrame:
    """Symbol-cleaned number (double)."""
    name = resolve_column(column, df.columns)
    return df.withColumn(name, clean_number(_c(name)))
