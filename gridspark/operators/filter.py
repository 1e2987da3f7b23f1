"""Row filters: one predicate compiler behind every filter form.

Null rules: a comparison, CONTAINS, STARTS/ENDS WITH or IN on a null value
is false (row dropped); the negated forms (!=, NOT CONTAINS, NOT IN) keep
null rows. Filters are plain ``where`` clauses, so Catalyst merges stacked
filters and pushes them into the Parquet scan.
"""

from __future__ import annotations

import re
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions.columns import resolve_column
from gridspark.functions.core import (FLAG_FALSY, FLAG_TEXT_VALUES, FLAG_TRUTHY, falsy,
                                      is_blank, similarity)
from gridspark.functions.core import truthy as _truthy




def _keep(c: Column) -> Column:
    return c


# Operator spellings accepted from users, mapped to our names.
OPERATOR_ALIASES = {
    "==": "eq", "=": "eq", "eq": "eq", "equals": "eq", "equal": "eq",
    "!=": "ne", "<>": "ne", "ne": "ne", "not equals": "ne", "not_equals": "ne", "not equal": "ne",
    ">": "gt", "gt": "gt", "greater": "gt", "greater than": "gt", "greater_than": "gt",
    "<": "lt", "lt": "lt", "less": "lt", "less than": "lt", "less_than": "lt",
    ">=": "ge", "ge": "ge", "greater_equals": "ge", "greater than or equal": "ge",
    "<=": "le", "le": "le", "less_equals": "le", "less than or equal": "le",
    "contains": "contains", "like": "contains", "~": "contains",
    "not contains": "not_contains", "not_contains": "not_contains", "!~": "not_contains",
    "starts with": "starts_with", "startswith": "starts_with", "starts": "starts_with",
    "starts_with": "starts_with",
    "ends with": "ends_with", "endswith": "ends_with", "ends": "ends_with", "ends_with": "ends_with",
    "is blank": "is_blank", "blank": "is_blank", "is_blank": "is_blank",
    "is not blank": "is_not_blank", "not blank": "is_not_blank", "is_not_blank": "is_not_blank",
    "is null": "is_null", "isnull": "is_null", "is_null": "is_null", "null": "is_null",
    "is not null": "is_not_null", "isnotnull": "is_not_null", "is_not_null": "is_not_null",
    "not null": "is_not_null",
    "in": "in", "is one of": "in", "is_one_of": "in",
    "not in": "not_in", "not_in": "not_in",
    "between": "between",
    "regex": "regex", "matches": "regex", "rlike": "regex",
}

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def canonical_operator(op: str) -> str:
    key = re.sub(r"\s+", " ", op.strip().lower())
    if key not in OPERATOR_ALIASES:
        raise ValueError(f"unknown filter operator {op!r}")
    return OPERATOR_ALIASES[key]


def _as_number(v):
    if isinstance(v, bool):
        return None
    if isinstance(v, (int, float)):
        return v
    try:
        s = str(v).strip()
        return int(s) if re.fullmatch(r"[+-]?\d+", s) else float(s)
    except (TypeError, ValueError):
        return None


def _split_list(value) -> list:
    if isinstance(value, (list, tuple, set)):
        return list(value)
    return [p.strip().strip("'\"") for p in str(value).split(",")]


def _bounds(value):
    if isinstance(value, (list, tuple)) and len(value) == 2:
        return value[0], value[1]
    s = str(value)
    day = r"(\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?)"
    m = re.fullmatch(rf"\s*{day}\s*(?:\.\.|,|to)\s*{day}\s*", s)
    if m:
        return m.group(1), m.group(2)
    m = re.fullmatch(r"\s*(-?[\d.eE+]+)\s*(?:\.\.|-|,)\s*(-?[\d.eE+]+)\s*", s)
    if not m:
        raise ValueError(f"between needs 'lo-hi', two ISO dates or (lo, hi), got {value!r}")
    return _as_number(m.group(1)), _as_number(m.group(2))


def _typed_operand(dtype: T.DataType, c: Column, value):
    """Return (column expression, literal) compared on a common type."""
    num = _as_number(value)
    if isinstance(dtype, _NUMERIC):
        if num is None:
            raise ValueError(f"numeric column compared with non-number {value!r}")
        return c, F.lit(num)
    if isinstance(dtype, T.TimestampNTZType):
        return c, F.lit(str(value)).cast("timestamp_ntz")
    if isinstance(dtype, T.TimestampType):
        return c, F.lit(str(value)).cast("timestamp")
    if isinstance(dtype, T.DateType):
        return c, F.lit(str(value)).cast("date")
    if isinstance(dtype, T.BooleanType):
        from gridspark.functions.core import to_bool
        return c, to_bool(F.lit(str(value)))
    if num is not None and not isinstance(value, str):
        return c.try_cast("double"), F.lit(float(num))
    if num is not None and isinstance(value, str) and isinstance(dtype, T.StringType):
        # numeric-looking literal against text: compare as numbers
        return c.try_cast("double"), F.lit(float(num))
    return c.cast("string"), F.lit(str(value))


def predicate(df: DataFrame, column, op: str, value=None, *, regex: bool = False,
              case: bool = False, where: bool = False) -> Column:
    """Compile ``column op value`` to a boolean Column that is never null.

    With ``where=True`` the positive operators are left in plain SQL form
    (null where the value is null). Inside a ``WHERE`` clause combined only
    with AND / OR this keeps exactly the same rows, and it lets Catalyst
    push the comparison into the Parquet scan (a ``coalesce`` wrapper would
    hide it). Negated operators always keep their null-keeping form.
    """
    truthy = _keep if where else _truthy
    name = resolve_column(column, df.columns)
    c = F.col(f"`{name}`")
    dtype = df.schema[name].dataType
    kind = canonical_operator(op)
    text = c.cast("string")

    if kind == "is_blank":
        return is_blank(c)
    if kind == "is_not_blank":
        return ~is_blank(c)
    if kind == "is_null":
        return c.isNull()
    if kind == "is_not_null":
        return c.isNotNull()
    if kind in ("contains", "not_contains"):
        if regex:
            hit = text.rlike(("" if case else "(?i)") + str(value))
        elif case:
            hit = text.contains(str(value))
        else:
            hit = F.lower(text).contains(str(value).lower())
        return truthy(hit) if kind == "contains" else falsy(hit)
    if kind == "starts_with":
        return truthy(text.startswith(str(value)))
    if kind == "ends_with":
        return truthy(text.endswith(str(value)))
    if kind == "regex":
        return truthy(text.rlike(str(value)))
    if kind in ("in", "not_in"):
        items = _split_list(value)
        nums = [_as_number(v) for v in items]
        if items and all(n is not None for n in nums):
            if isinstance(dtype, _NUMERIC):
                whole = all(float(n).is_integer() for n in nums) and not isinstance(
                    dtype, (T.FloatType, T.DoubleType, T.DecimalType))
                hit = c.isin(*[int(n) if whole else float(n) for n in nums])
            else:
                hit = c.try_cast("double").isin(*[float(n) for n in nums])
        else:
            hit = F.trim(text).isin(*[str(v).strip() for v in items])
        return truthy(hit) if kind == "in" else falsy(hit)
    if kind == "between":
        lo, hi = _bounds(value)
        left, lo_lit = _typed_operand(dtype, c, lo)
        _, hi_lit = _typed_operand(dtype, c, hi)
        return truthy(left.between(lo_lit, hi_lit))

    left, lit = _typed_operand(dtype, c, value)
    if kind == "eq":
        return truthy(left == lit)
    if kind == "ne":
        return ~left.eqNullSafe(lit)
    cmp = {"gt": left > lit, "lt": left < lit, "ge": left >= lit, "le": left <= lit}
    return truthy(cmp[kind])


def filter_rows(df: DataFrame, column, op: str, value=None, **kw) -> DataFrame:
    """Keep rows where ``column op value`` holds."""
    return df.where(predicate(df, column, op, value, where=True, **kw))


def filter_multi(df: DataFrame, conditions: Sequence) -> DataFrame:
    """conditions ``(col, op, value[, logic])`` combined strictly left to
    right, without precedence: ``((c1 AND c2) OR c3) ...``. ``logic`` joins a
    condition to everything before it ('and' default, or 'or')."""
    if not conditions:
        return df
    acc = None
    for cond in conditions:
        if isinstance(cond, dict):
            col, op, val = cond["column"], cond["op"], cond.get("value")
            logic = cond.get("logic", "and")
            extra = {k: cond[k] for k in ("regex", "case") if k in cond}
        else:
            col, op, val = cond[0], cond[1], cond[2] if len(cond) > 2 else None
            logic = cond[3] if len(cond) > 3 else "and"
            extra = {}
        p = predicate(df, col, op, val, where=True, **extra)
        logic = str(logic).strip().lower()
        if acc is None:
            acc = p
        elif logic in ("and", "a", "&"):
            acc = acc & p
        elif logic in ("or", "o", "|"):
            acc = acc | p
        else:
            raise ValueError(f"unknown logic {logic!r}")
    return df.where(acc)


def filter_stack(df: DataFrame, filters: Iterable, strict: bool = False) -> DataFrame:
    """AND of one condition per entry ``(col, op, value)`` or dict.

    Entries naming a column the table no longer has are skipped (a saved
    stack outliving a dropped column), unless ``strict``.
    """
    out = df
    for f in filters:
        if isinstance(f, dict):
            col, op, val = f["column"], f["op"], f.get("value")
        else:
            col, op, val = f
        if col not in df.columns:
            if strict:
                raise KeyError(f"unknown column {col!r}")
            continue
        out = out.where(predicate(df, col, op, val, where=True))
    return out


def flag_columns(df: DataFrame) -> DataFrame:
    """F16 detection: one row per flag-like column with its true/false counts.

    Flags are boolean columns, numeric columns holding only 0/1 and text
    columns holding only yes/no/y/n/true/false (any case). One aggregation
    pass; the result has at most one row per column.
    """
    exprs, kinds = [], {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            kinds[f.name] = "bool"
            ok = F.lit(True)
            t_ = c
        elif isinstance(f.dataType, _NUMERIC):
            kinds[f.name] = "number"
            ok = c.isin(0, 1)
            t_ = c == 1
        elif isinstance(f.dataType, T.StringType):
            kinds[f.name] = "text"
            ok = F.lower(c).isin(*FLAG_TEXT_VALUES)
            t_ = F.lower(c).isin(*FLAG_TRUTHY)
        else:
            continue
        exprs.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(kinds[f.name]).alias("kind"),
            F.bool_and(F.when(c.isNotNull(), ok)).alias("is_flag"),
            F.count_if(_truthy(t_)).alias("n_true"),
            F.count_if(c.isNotNull() & ~_truthy(t_)).alias("n_false")))
    if not exprs:
        return df.sparkSession.createDataFrame(
            [], "column string, kind string, n_true long, n_false long")
    stats = df.agg(F.array(*exprs).alias("s")).select(F.inline("s"))
    return stats.where("is_flag").drop("is_flag")


def filter_flag(df: DataFrame, column, keep: bool = True) -> DataFrame:
    """F16: keep the true (or false) side of a flag column."""
    name = resolve_column(column, df.columns)
    c = F.col(f"`{name}`")
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.BooleanType):
        return df.where(c == F.lit(keep))
    if isinstance(dtype, _NUMERIC):
        return df.where(c == F.lit(1 if keep else 0))
    words = FLAG_TRUTHY if keep else FLAG_FALSY
    return df.where(F.lower(c.cast("string")).isin(*words))


def filter_expr(df: DataFrame, text: str) -> DataFrame:
    """filter by a Spark SQL boolean expression (``==``, ``and``/``or``
    and backticked names are accepted)."""
    return df.where(F.expr(text))


def closest_value(df: DataFrame, column, typed: str, threshold: float = 60.0) -> Column:
    """Scalar subquery: the existing value of ``column`` most similar to
    ``typed`` (score >= threshold; ties to the smaller value), else null.

    Work is one distinct + one aggregate; only a single value reaches the
    plan, as a broadcast scalar.
    """
    name = resolve_column(column, df.columns)
    v = F.col(f"`{name}`").cast("string")
    cands = df.select(v.alias("v")).where("v IS NOT NULL").distinct()
    scored = cands.select("v", similarity(F.col("v"), F.lit(typed)).alias("score"))
    best = scored.where(F.col("score") >= threshold).agg(
        F.min_by("v", F.struct(-F.col("score"), F.col("v"))).alias("best"))
    return best.scalar()


def filter_fuzzy_value(df: DataFrame, column, typed: str, threshold: float = 60.0) -> DataFrame:
    """snap a typed value to the nearest existing one, then filter ==."""
    name = resolve_column(column, df.columns)
    return df.where(F.col(f"`{name}`").cast("string") == closest_value(df, name, typed, threshold))
